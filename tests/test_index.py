"""The stored index gives what a scan gives, and reads only what it must."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from colloquy.operators import index, search
from colloquy.sources import tables

AT = dt.datetime(2024, 1, 1)


def found(rows):
    return sorted((r["session_id"] if "session_id" in rows.columns else r["owner"], r["ordinal"], r["rank"]) for r in rows.collect())


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    rows = tables.messages(spark, sf_dir)
    path = f"{tmp_path_factory.mktemp('index')}/of"
    for part in range(3):
        index.append(rows.where(F.col("ordinal") % 3 == part), path, file_rows=2000)
    return rows, path


@pytest.mark.parametrize("keyword", ["and with this", "la", "THE", "nowhereatall", "", "a"])
@pytest.mark.parametrize("limit", [1, 3, 10])
def test_search_equals_a_scan(spark, stored, keyword, limit):
    rows, path = stored
    assert found(index.search(spark, path, keyword, limit=limit)) == found(search.search_messages(rows, keyword, limit=limit))


def test_time_and_owner(spark, stored):
    rows, path = stored
    start, end = AT + dt.timedelta(minutes=61), AT + dt.timedelta(hours=30)
    assert found(index.search(spark, path, "la de", start=start, end=end, limit=2)) == found(search.search_messages(rows, "la de", start=start, end=end, limit=2))
    one = found(search.search_messages(rows, "la"))[0][0]
    assert found(index.search(spark, path, "la", owner=one)) == [x for x in found(search.search_messages(rows, "la")) if x[0] == one]


def test_compaction_keeps_the_answers(spark, stored, tmp_path):
    rows, path = stored
    index.compact(spark, path, f"{tmp_path}/small")
    assert found(index.search(spark, f"{tmp_path}/small", "and la", limit=2)) == found(index.search(spark, path, "and la", limit=2))
    assert index.stored(spark, f"{tmp_path}/small").count() == index.stored(spark, path).count()


def test_only_the_keyword_is_read(spark, stored):
    _, path = stored
    plan = index.search(spark, path, "with", limit=5)._jdf.queryExecution().toString()
    bucket = index._buckets_of(spark, ["with"])[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}\)", plan)
    assert re.search(r"PushedFilters: \[[^\n]*EqualTo\(term,with\)", plan) and "LessThanOrEqual(rank,5)" in plan
    read = index.lookup(spark, path, "with").select("bucket", F.input_file_name().alias("f")).distinct().collect()
    assert {r["bucket"] for r in read} == {bucket} and all(f"bucket={bucket}/" in r["f"] for r in read)


def test_odd_rows(spark, tmp_path):
    schema = "session_id string, ordinal long, content string, created_at timestamp_ntz, term string, rank string"
    rows = [("a", 1, None, AT, None, None), ("a", 2, "", AT, None, None), ("a", 3, "word word Word x", AT, None, None), (None, 4, "word", None, None, None), ("b", 5, "word " * 50_000, AT, None, None)]
    docs = spark.createDataFrame(rows, schema)
    index.append(docs, f"{tmp_path}/i")
    assert index.stored(spark, f"{tmp_path}/i").count() == 3
    assert {(r["owner"], r["ordinal"]) for r in index.search(spark, f"{tmp_path}/i", "word").collect()} == {("a", 3), (None, 4), ("b", 5)}
    index.append(docs.limit(0), f"{tmp_path}/i")
    assert index.stored(spark, f"{tmp_path}/i").count() == 3
