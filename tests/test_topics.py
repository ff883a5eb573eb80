"""Each event of a topic once, whatever fails and starts again."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.sources import topics


def parts(path, topic="t"):
    return len(os.listdir(f"{path}/{topic}/parts"))


def write(spark, folder, rows):
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(0.02)


def stream(spark, folder, a_batch=1):
    return spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", a_batch).parquet(f"{folder}/in")


def held(spark, folder):
    return Counter((r["key"], r["value"], r["headers"].get("h")) for r in topics.read(spark, f"{folder}/topics", "t").collect())


def test_batches_and_replay(spark, tmp_path):
    for k in range(4):
        write(spark, tmp_path, [(f"k{k}", "ä\n%d" % j) for j in range(5)] + [(None, None)])
    topics.send(stream(spark, tmp_path), f"{tmp_path}/topics", "t", f"{tmp_path}/log", {"h": "x"})
    want = Counter([(f"k{k}", "ä\n%d" % j, "x") for k in range(4) for j in range(5)] + [(None, None, "x")] * 4)
    assert held(spark, tmp_path) == want
    later = topics.read(spark, f"{tmp_path}/topics", "t", start=2).collect()
    assert {r["batch"] for r in later} == {2, 3} and len(later) == 12
    again = topics.read(spark, f"{tmp_path}/topics", "t", start=2).collect()
    assert Counter(map(str, later)) == Counter(map(str, again))


def test_a_batch_that_fails_and_runs_again(spark, tmp_path):
    """The third batch dies half way, then the stream starts from its log."""
    for k in range(3):
        write(spark, tmp_path, [(f"k{k}", str(j)) for j in range(4)])
    mark = tmp_path / "fixed"

    @F.udf("string")
    def fragile(value):
        if value == "k2/3" and not os.path.exists(str(mark)):
            raise RuntimeError("half way")
        return value

    def send():
        rows = stream(spark, tmp_path).select("key", fragile(F.concat_ws("/", "key", "value")).alias("value"))
        return topics.send(rows, f"{tmp_path}/topics", "t", f"{tmp_path}/log")

    with pytest.raises(Exception, match="half way"):
        send()
    assert sum(held(spark, tmp_path).values()) == 8
    mark.touch()
    send()
    assert held(spark, tmp_path) == Counter((f"k{k}", f"k{k}/{j}", None) for k in range(3) for j in range(4))


def test_a_batch_that_is_committed_twice(spark, tmp_path):
    """A driver that dies after its sink's commit and before its own runs the
    batch again: what was sent stays once, and no part is left over."""
    write(spark, tmp_path, [("a", "1"), ("b", "2")])
    topics.send(stream(spark, tmp_path), f"{tmp_path}/topics", "t", f"{tmp_path}/log")
    before = parts(f"{tmp_path}/topics")
    os.remove(f"{tmp_path}/log/commits/0")
    for extra in (f"{tmp_path}/log/commits/.0.crc",):
        if os.path.exists(extra):
            os.remove(extra)
    write(spark, tmp_path, [("c", "3")])
    topics.send(stream(spark, tmp_path), f"{tmp_path}/topics", "t", f"{tmp_path}/log")
    assert held(spark, tmp_path) == Counter({("a", "1", None): 1, ("b", "2", None): 1, ("c", "3", None): 1})
    assert parts(f"{tmp_path}/topics") == before + 1


def test_a_reading_stream_goes_on(spark, tmp_path):
    def rows():
        query = topics.read(spark, f"{tmp_path}/topics", "t", stream=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/read")
        query.trigger(availableNow=True).start().awaitTermination()
        return Counter((r["key"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    write(spark, tmp_path, [("a", "1")])
    topics.send(stream(spark, tmp_path), f"{tmp_path}/topics", "t", f"{tmp_path}/log")
    assert rows() == Counter({("a", "1"): 1})
    write(spark, tmp_path, [("a", "2"), ("a", "2")])
    topics.send(stream(spark, tmp_path), f"{tmp_path}/topics", "t", f"{tmp_path}/log")
    assert rows() == Counter({("a", "1"): 1, ("a", "2"): 2})


def test_batch_writes_and_empty_topics(spark, tmp_path):
    spark.dataSource.register(topics.Topic)
    assert topics.read(spark, f"{tmp_path}", "none").count() == 0
    rows = topics.events(spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string"))
    for _ in range(2):
        rows.write.format("topic").option("path", str(tmp_path)).option("topic", "t").mode("append").save()
    rows.limit(0).write.format("topic").option("path", str(tmp_path)).option("topic", "t").mode("append").save()
    assert Counter((r["key"], r["value"]) for r in topics.read(spark, str(tmp_path), "t").collect()) == Counter({("a", "1"): 2, ("b", None): 2})
