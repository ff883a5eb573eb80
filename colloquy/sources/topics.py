"""Topics of events in a shared folder, as a Spark data source.

``topic`` is written by batches and streams and read by both. A task writes its
events to a part of its own; the driver's commit names the parts of a batch in
one small manifest, which appears whole or not at all. A batch that runs again
after a failure finds its manifest and throws its own parts away, and a batch
that fails leaves none, so readers see each event once. A reader's offset is
the number of the next manifest: it starts anywhere and replays the same rows.

The folder is any that pyarrow reaches by its address, one that all executors
and the driver see. Columns: key, value, headers (a map), and on reading also
``batch``, the manifest that named the event.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

WRITTEN = "key string, value string, headers map<string,string>"


class _Folder:
    """A topic's folder: parts, and manifests that name those that count."""

    def __init__(self, options: dict):
        where = options["path"]
        self.fs, root = fs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (fs.LocalFileSystem(), where)
        self.root = f"{root}/{options['topic']}"

    def put(self, name: str, data: bytes) -> None:
        """A file that is there whole or not at all."""
        folder, _, last = f"{self.root}/{name}".rpartition("/")
        self.fs.create_dir(folder, recursive=True)
        with self.fs.open_output_stream(draft := f"{folder}/.{uuid.uuid4().hex}") as out:
            out.write(data)
        self.fs.move(draft, f"{folder}/{last}")

    def get(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}") as file:
            return file.read()

    def drop(self, names: list[str]) -> None:
        for name in names:
            if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.File:
                self.fs.delete_file(f"{self.root}/{name}")

    def manifests(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/manifests", allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith("."))


@dataclass
class _Written(WriterCommitMessage):
    part: str | None
    n: int


class _Writer(DataSourceWriter, DataSourceStreamWriter):
    """A batch of a stream is named by the stream and its number, a batch of
    its own by a new name."""

    def __init__(self, options: dict):
        self.options, self.writer = dict(options), options.get("writer") or uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Written:
        lines = [json.dumps([r["key"], r["value"], dict(r["headers"] or {})], ensure_ascii=False) for r in iterator]
        if not lines:
            return _Written(None, 0)
        part = f"parts/{uuid.uuid4().hex}"
        _Folder(self.options).put(part, "\n".join(lines).encode())
        return _Written(part, len(lines))

    def commit(self, messages: list, batchId: int | None = None) -> None:
        folder, parts = _Folder(self.options), [m.part for m in messages if m and m.part]
        own = f"{self.writer}-{'batch' if batchId is None else batchId}"
        known = folder.manifests()
        if any(m.partition(".")[2] == own for m in known):
            folder.drop(parts)
        else:
            place = 1 + max((int(m.partition(".")[0]) for m in known), default=-1)
            folder.put(f"manifests/{place:012d}.{own}", json.dumps(parts).encode())

    def abort(self, messages: list, batchId: int | None = None) -> None:
        _Folder(self.options).drop([m.part for m in messages if m and m.part])


@dataclass
class _Part(InputPartition):
    batch: int
    name: str


class _Reads:
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def initialOffset(self) -> dict:
        return {"next": int(self.options.get("startingoffset", 0))}

    def latestOffset(self) -> dict:
        known = _Folder(self.options).manifests()
        return {"next": 1 + int(known[-1].partition(".")[0]) if known else 0}

    def partitions(self, start: dict | None = None, end: dict | None = None) -> list[_Part]:
        folder = _Folder(self.options)
        low, high = (start or self.initialOffset())["next"], (end or self.latestOffset())["next"]
        named = [(int(m.partition(".")[0]), m) for m in folder.manifests()]
        return [_Part(k, part) for k, m in named if low <= k < high for part in json.loads(folder.get(f"manifests/{m}"))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for line in _Folder(self.options).get(partition.name).decode().split("\n") if partition else ():
            yield (*json.loads(line), partition.batch)


class _BatchReader(_Reads, DataSourceReader):
    pass


class _StreamReader(_Reads, DataSourceStreamReader):
    pass


class Topic(DataSource):
    """Options: path, topic; for writers ``writer``, the name of a stream that
    may start again; for readers ``startingOffset``."""

    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return f"{WRITTEN}, batch long"

    def reader(self, schema) -> _BatchReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite) -> _Writer:
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite) -> _Writer:
        return _Writer(self.options)


def events(rows: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """(key, value, headers): every row's ``key`` and ``value`` with the same
    headers."""
    made = F.create_map(*[F.lit(x) for pair in (headers or {}).items() for x in pair]).cast("map<string,string>")
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), made.alias("headers"))


def send(rows: DataFrame, path: str, topic: str, checkpoint: str, headers: dict[str, str] | None = None):
    """Write a stream of (key, value) to a topic, as far as its source goes
    now. The checkpoint names the writer, so each batch counts once however
    often it runs."""
    rows.sparkSession.dataSource.register(Topic)
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    query = events(rows, headers).writeStream.format("topic").option("path", path).option("topic", topic).option("writer", name)
    started = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def read(spark: SparkSession, path: str, topic: str, stream: bool = False, start: int = 0) -> DataFrame:
    """The events of a topic from manifest ``start`` on."""
    spark.dataSource.register(Topic)
    source = spark.readStream if stream else spark.read
    return source.format("topic").option("path", path).option("topic", topic).option("startingOffset", str(start)).load()
