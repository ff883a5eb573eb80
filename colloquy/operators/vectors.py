"""Vector recall for a table of queries, exact and through an inverted index.

Vectors are scaled to length one. Coarse centroids and the books of a product
quantiser are fitted on a sample of ``sample_rows`` rows, taken by a hash of
the id; the index then holds every row: its list, the nearest centroid, and a
code of a byte a part for the rest of it. A query is of one user, and looks at
that user's lists from the nearest on until these hold ``least`` of the user's
rows, so a small store is looked at whole and a large one in part. Codes give
``refine`` rows a query, whose vectors are then read for the exact score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS
from .memory import cosine


@dataclass
class Quantiser:
    """``lists``: (lists, d) centroids. ``books``: (parts, codes, d / parts)."""

    lists: np.ndarray
    books: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of each row of ``x``."""
        of = nearest(x, self.lists)
        rest = (x - self.lists[of]).reshape(len(x), len(self.books), -1)
        return of, np.column_stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)]).astype(np.uint8)

    def decode(self, of: np.ndarray, code: np.ndarray) -> np.ndarray:
        parts = [book[code[:, p]] for p, book in enumerate(self.books)]
        return self.lists[of] + np.hstack(parts)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def centres(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means of a sample; a centre that loses its rows takes the farthest."""
    draw = np.random.default_rng(seed)
    out = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, out)
        total, n = np.zeros_like(out), np.bincount(of, minlength=len(out))
        np.add.at(total, of, x)
        far = ((x - out[of]) ** 2).sum(axis=1)
        out = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], out)
        for empty in np.flatnonzero(n == 0):
            out[empty] = x[int(far.argmax())]
            far[int(far.argmax())] = 0
    return out


def _rows(vectors: pa.Array, d: int) -> np.ndarray:
    """Unit rows of ``d`` dimensions; a null, odd or zero vector is all zero."""
    out = np.zeros((len(vectors), d))
    for k, v in enumerate(vectors.to_pylist()):
        if v is not None and len(v) == d and None not in v:
            out[k] = v
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=(size > 0) & np.isfinite(size))


def fit(memories: DataFrame, lists: int | None = None, parts: int = 8, sample_rows: int = 20_000) -> Quantiser:
    """A quantiser from at most ``sample_rows`` vectors, which is all that
    passes the driver. ``lists`` is by default the root of the table's rows,
    1024 at most."""
    rows = memories.where(F.size("embedding") > 0)
    sample = rows.orderBy(F.xxhash64(F.col("id"))).limit(sample_rows).select("embedding").toArrow().column("embedding").combine_chunks()
    d = max((len(v) for v in sample.to_pylist()), default=parts)
    d += -d % parts
    x = _rows(pa.array([None if v is None else list(v) + [0.0] * (d - len(v)) for v in sample.to_pylist()], pa.list_(pa.float64())), d)
    x = x if len(x) else np.zeros((1, d))
    coarse = centres(x, lists or max(1, min(1024, int(rows.count() ** 0.5))))
    rest = (x - coarse[nearest(x, coarse)]).reshape(len(x), parts, -1)
    return Quantiser(coarse, np.stack([np.resize(own := centres(rest[:, p], 256), (256, own.shape[1])) for p in range(parts)]))


def append(memories: DataFrame, quantiser: Quantiser, path: str) -> None:
    """Add (id, user_id, code) of every row to the index, a folder a list,
    sorted by user. A list's rows are dealt over tasks by user and id."""
    d = quantiser.lists.shape[1]
    sent = memories.sparkSession.sparkContext.broadcast(quantiser)
    kinds = memories.select("id", "user_id").schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            of, code = sent.value.encode(_rows(pa.array([None if v is None else list(v) + [0.0] * (d - len(v)) for v in b.column(2).to_pylist()], pa.list_(pa.float64())), d))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "user_id", "list", "code"])

    coded = memories.select("id", "user_id", "embedding").mapInArrow(batches, f"id {kinds['id'].dataType.simpleString()}, user_id string, list int, code binary")
    coded.repartition("list", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("list", "user_id").write.mode("append").partitionBy("list").parquet(path)


def exact(memories: DataFrame, queries: DataFrame, limit: int = SETTINGS.recall_limit) -> DataFrame:
    """(user_id, id, score, rank): of each query (user_id, query) the user's
    ``limit`` nearest items. A window group limit keeps a heap a task."""
    scored = memories.join(queries, "user_id").withColumn("score", F.coalesce(cosine(F.col("embedding"), F.col("query")), F.lit(0.0)))
    return top(scored, limit).drop("embedding", "query")


def top(scored: DataFrame, limit: int, by: str = "score") -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def probes(spark: SparkSession, index: DataFrame, queries: DataFrame, quantiser: Quantiser, least: int) -> DataFrame:
    """(user_id, query, list): the lists that each query looks at."""
    centroids = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(quantiser.lists)], "list int, centroid array<double>")
    held = index.groupBy("user_id", "list").agg(F.count("*").alias("n"))
    near = held.join(queries, "user_id").join(F.broadcast(centroids), "list").withColumn("near", _dot(F.col("query"), F.col("centroid")))
    w = Window.partitionBy("user_id").orderBy(F.desc("near"), "list").rowsBetween(Window.unboundedPreceding, -1)
    return near.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < least).select("user_id", "query", "list")


def search(memories: DataFrame, queries: DataFrame, quantiser: Quantiser, path: str, limit: int = SETTINGS.recall_limit, least: int = 2000, refine: int = 100) -> DataFrame:
    """(user_id, id, score, rank) as ``exact``, through the index at ``path``."""
    spark, d = memories.sparkSession, quantiser.lists.shape[1]
    index = spark.read.parquet(path)
    double = queries.select("user_id", F.col("query").cast("array<double>").alias("query"))
    met = index.join(probes(spark, index, double, quantiser, least), ["user_id", "list"])
    sent = spark.sparkContext.broadcast(quantiser)
    kind = memories.schema["id"].dataType.simpleString()

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            code = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1)
            asked = _rows(pa.array([None if v is None else list(v) + [0.0] * (d - len(v)) for v in b.column(4).to_pylist()], pa.list_(pa.float64())), d)
            near = (sent.value.decode(b.column(2).to_numpy(), code) * asked).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], names=["id", "user_id", "near"])

    guessed = met.select("id", "user_id", "list", "code", "query").mapInArrow(score, f"id {kind}, user_id string, near double")
    best = top(guessed, refine, "near").select("id", "user_id")
    return exact(memories.join(best, ["id", "user_id"], "left_semi"), queries, limit)
