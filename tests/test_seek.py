"""Pages by the last row seen equal pages by their number."""

from pyspark.sql import functions as F

from colloquy.operators import history
from colloquy.sources import tables


def test_seek_pages_equal_numbered_pages(spark, sf_dir):
    rows = history.dialogue(tables.messages(spark, sf_dir)).select("session_id", "created_at", "ordinal")
    last = rows.limit(0)
    for page in (1, 2, 3, 4):
        got = history.seek(rows, last, "session_id", history.IN_TIME, 3)
        want = history.paged(rows, "session_id", [F.col("created_at"), F.col("ordinal")], page, 3).where("ordinal is not null")
        pairs = lambda df: sorted((r["session_id"], r["ordinal"]) for r in df.collect())
        assert pairs(got) == pairs(want)
        # A session whose pages are over keeps its last row.
        newest = got.select("session_id", *history.IN_TIME).unionByName(last.select("session_id", *history.IN_TIME))
        ends = newest.groupBy("session_id").agg(F.max(F.struct(*history.IN_TIME)).alias("l")).select("session_id", "l.*")
        last = spark.createDataFrame(ends.collect(), "session_id string, created_at timestamp_ntz, ordinal long")


def test_ties_and_unknown_sessions(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 5, 1)], "session_id string, created_at int, ordinal int")
    last = spark.createDataFrame([("a", 1, 2), ("z", 0, 0)], "session_id string, created_at int, ordinal int")
    got = sorted((r["session_id"], r["ordinal"], r["rank"]) for r in history.seek(rows, last, "session_id", history.IN_TIME, 2).collect())
    assert got == [("a", 3, 1), ("b", 1, 1)]
    plan = history.seek(rows, last, "session_id", history.IN_TIME, 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
