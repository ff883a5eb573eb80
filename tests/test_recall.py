"""Recall of the vector index against exact search, and the second stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import memory, vectors
from colloquy.plans import recalls
from colloquy.sources import tables


def pairs(found):
    return {(r["user_id"], r["id"]) for r in found.collect()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """One user holds two thirds of all rows; vectors in loose clusters."""
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(30, 32))
    rows = []
    for k in range(9000):
        v = middle[draw.integers(30)] + 0.7 * draw.normal(size=32)
        rows.append((k, "u0" if k % 3 else f"u{1 + k % 40}", f"memory {k}", [float(x) for x in v]))
    path = f"{tmp_path_factory.mktemp('vectors')}/rows"
    spark.createDataFrame(rows, "id long, user_id string, memory string, embedding array<float>").write.parquet(path)
    asked = [(u, [float(x) for x in middle[draw.integers(30)] + 0.7 * draw.normal(size=32)]) for u in {r[1] for r in rows}]
    return spark.read.parquet(path), spark.createDataFrame(asked, "user_id string, query array<float>")


def test_recall_of_the_index(spark, store, tmp_path):
    memories, queries = store
    quantiser = vectors.fit(memories, sample_rows=3000)
    for half in (0, 1):  # appended in two parts
        vectors.append(memories.where(F.col("id") % 2 == half), quantiser, f"{tmp_path}/lists")
    index = spark.read.parquet(f"{tmp_path}/lists")
    assert index.count() == memories.count()
    want = pairs(vectors.exact(memories, queries))
    found = vectors.search(memories, queries, quantiser, f"{tmp_path}/lists", least=1500, refine=60)
    got = pairs(found)
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)
    # The frequent user's query looks at a part of that user's rows.
    seen = index.join(vectors.probes(spark, index, queries.select("user_id", F.col("query").cast("array<double>").alias("query")), quantiser, 1500), ["user_id", "list"])
    frequent = seen.where("user_id = 'u0'").count()
    assert frequent < 0.5 * memories.where("user_id = 'u0'").count()
    of = {(u, i) for u, i in want if u == "u0"}
    assert len(of & got) >= 0.9 * len(of)
    # Scores are exact, whatever the codes say.
    score = {(r["user_id"], r["id"]): r["score"] for r in vectors.exact(memories, queries, 500).collect()}
    assert all(r["score"] == pytest.approx(score[r["user_id"], r["id"]]) for r in found.collect())


def test_given_tables(spark, sf_dir):
    memories, queries = tables.memories(spark, sf_dir), recalls.asked(spark, sf_dir).drop("asked_id")
    want = pairs(vectors.exact(memories, queries))
    assert pairs(recalls.indexed_recall(spark, sf_dir)) == want


def test_odd_vectors(spark, tmp_path):
    schema = "id long, user_id string, memory string, embedding array<float>"
    rows = [(1, "a", "m", [1.0, 0.0, 0.0]), (2, "a", "m", [0.0, 0.0, 0.0]), (3, "a", "m", None), (4, "a", "m", []), (5, None, "m", [1.0, 1.0, 0.0]), (6, "b", "m", [1.0, 0.0]), (1, "a", "m", [1.0, 0.0, 0.0])]
    memories = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("c", [1.0, 0.0, 0.0])], "user_id string, query array<float>")
    quantiser = vectors.fit(memories)
    vectors.append(memories, quantiser, f"{tmp_path}/lists")
    got = vectors.search(memories, queries, quantiser, f"{tmp_path}/lists").orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got][:2] == [(1, 1.0), (1, 1.0)] and {r["user_id"] for r in got} == {"a"}
    assert vectors.fit(memories.limit(0)).lists.shape[0] == 1


def test_second_stage(spark):
    rows = [("u", 1, 0.9, "green tea leaves"), ("u", 2, 0.8, "train to Berlin"), ("u", 3, 0.7, "trains from Berlin"), ("u", 4, 0.6, None), ("u", 5, 0.5, ""), ("v", 6, 0.1, "Berlin")]
    found = spark.createDataFrame(rows, "user_id string, id long, score double, memory string").withColumn("rank", F.lit(1))
    got = memory.reranked(found, memory.max_similarity(F.lit("the train to berlin"), F.col("memory")), limit=3).orderBy("user_id", "rank").collect()
    assert [(r["user_id"], r["id"]) for r in got] == [("u", 2), ("u", 3), ("u", 1), ("v", 6)]
    # A threshold is on the second score, not the first.
    kept = memory.reranked(found, memory.max_similarity(F.lit("Berlin"), F.col("memory")), threshold=0.9).collect()
    assert {r["id"] for r in kept} == {2, 3, 6} and all(r["rerank_score"] == 1.0 for r in kept)
    assert memory.reranked(found, memory.max_similarity(F.lit(""), F.col("memory"))).where("rerank_score > 0").count() == 0
