"""Keyed streaming state: the same rows however a stream is cut, after a
restart, with a bounded state, a time to live and an initial state."""

import json
import time

import pytest
from pyspark.sql import functions as F

from colloquy.operators import mutations
from colloquy.plans import turns
from colloquy.sources import tables
from colloquy.streaming import processors, state


@pytest.fixture(scope="module")
def cut(spark, sf_dir, tmp_path_factory):
    """The events as seven files in order of time, and the folder's parent."""
    root = tmp_path_factory.mktemp("cut")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["ts", "event_id"], kind="stable")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (root / "events.parquet").mkdir()
    size = -(-len(events) // 7)
    for k in range(7):
        part = f"{root}/part{k}"
        spark.createDataFrame(events.iloc[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(part)
        (file,) = (p for p in (root / f"part{k}").iterdir() if p.suffix == ".parquet")
        file.rename(root / "events.parquet" / f"{k}.parquet")
        time.sleep(0.02)  # the source takes files in order of their times
    return str(root)


def rows(found):
    return sorted(map(repr, found.collect()))


def files(spark, path, a_batch, **more):
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", a_batch).parquet(path)
    return tables.fragments_of(raw).select("call", "seq", F.col("event_id").alias("tie"), "index", "id", "name", "arguments", "content", "finish_reason")


@pytest.mark.parametrize("a_batch", [1, 2, 7])
def test_completions_do_not_depend_on_batches(spark, sf_dir, cut, a_batch):
    got = state.appended(processors.completions(files(spark, f"{cut}/events.parquet", a_batch)))
    assert rows(got) == rows(state.appended(processors.completions(state.delta_stream(spark, sf_dir)))) and got.count() > 50


@pytest.mark.parametrize("a_batch", [1, 3])
def test_texts_do_not_depend_on_batches(spark, sf_dir, cut, a_batch):
    versions = state.appended(state.assembled_text(files(spark, f"{cut}/events.parquet", a_batch)))
    latest = mutations.latest(versions, "call", "version").select("call", "content")
    assert rows(latest) == rows(turns.stream_text(spark, sf_dir)) and versions.count() > latest.count()


def test_fragments_after_an_end(spark, tmp_path):
    """The three fragments that one batch and two batches once told apart."""
    schema = "call string, seq long, content string, finish_reason string"
    parts = [[("c", 1, "a", None), ("c", 2, "b", "stop")], [("c", 3, "c", None)], [("c", 4, None, "stop")]]
    want = [("c", 0, "ab", "stop"), ("c", 1, "c", "stop")]
    for cuts in ([[0, 1, 2]], [[0], [1, 2]], [[0], [1], [2]]):
        folder = tmp_path / f"in{len(cuts)}"
        for own in cuts:
            spark.createDataFrame([r for k in own for r in parts[k]], schema).coalesce(1).write.mode("append").parquet(str(folder))
            time.sleep(0.02)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        got = state.appended(processors.completions(stream)).orderBy("completion").collect()
        assert [(r["call"], r["completion"], r["content"], r["finish_reason"]) for r in got] == want and got[0]["tool_calls"] == []


def test_restart_goes_on_where_it_stopped(spark, sf_dir, cut, tmp_path):
    """Half of the files, then, from the checkpoint, the other half."""
    import shutil

    (tmp_path / "in").mkdir()
    out = f"{tmp_path}/out"

    def run():
        query = processors.completions(files(spark, f"{tmp_path}/in", 1)).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()

    for part in (range(3), range(3, 7)):
        for k in part:
            shutil.copy(f"{cut}/events.parquet/{k}.parquet", f"{tmp_path}/in/{k}.parquet")
            time.sleep(0.02)
        run()
    assert rows(spark.read.parquet(out)) == rows(state.appended(processors.completions(state.delta_stream(spark, sf_dir))))


def test_hot_lists_do_not_depend_on_batches(spark, tmp_path):
    schema = "session_id string, ordinal long, content string, at timestamp"
    for k in range(6):
        spark.createDataFrame([("a", 10 * k + j, f"m{j}" if j else None, None) for j in range(10)] + [("b", k, "ä", None)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    lists = {}
    for a_batch in (1, 2, 6):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", a_batch).parquet(f"{tmp_path}/in")
        latest = mutations.latest(state.appended(state.hot_lists(stream, 4, seconds=None)), "session_id", "version").collect()
        lists[a_batch] = {r["session_id"]: (r["version"], r["messages"]) for r in latest}
    assert lists[1] == lists[2] == lists[6]
    version, held = lists[1]["a"]
    assert version == 60 and [m["ordinal"] for m in json.loads(held)] == [56, 57, 58, 59] and json.loads(lists[1]["b"][1])[-1] == {"ordinal": 5, "content": "ä", "at": None}


def test_state_stays_bounded(spark, tmp_path):
    """A list is cut at twice its length, however long the session is."""
    schema = "session_id string, ordinal long, content string"
    for k in range(8):
        spark.createDataFrame([("a", 100 * k + j, "x" * 50) for j in range(100)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = processors.hot_lists(stream, 5, None).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/log").option("stateVarName", "items").load()
    assert kept.count() <= 10


def test_lists_begin_with_the_cold_table(spark, tmp_path):
    schema = "session_id string, ordinal long, content string"
    cold = spark.createDataFrame([("a", k, f"old{k}") for k in range(9)] + [("z", 1, "never written")], schema)
    spark.createDataFrame([("a", 9, "new"), ("b", 1, "first")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    got = {r["session_id"]: (r["version"], [m["content"] for m in r["messages"]]) for r in state.appended(processors.hot_lists(stream, 3, None, cold)).collect()}
    assert got == {"a": (10, ["old7", "old8", "new"]), "b": (1, ["first"])}


def test_calls_that_never_end(spark, tmp_path):
    schema = "call string, seq long, content string, finish_reason string"
    spark.createDataFrame([("open", 1, "so far", None), ("done", 1, "all", "stop")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = processors.completions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), seconds=2)
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            rows = spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            if len(rows) == 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert {(r["call"], r["content"], r["finish_reason"]) for r in rows} == {("open", "so far", None), ("done", "all", "stop")}
