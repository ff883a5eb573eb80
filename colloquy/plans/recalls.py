"""Queries of memory recall for a table of query vectors, one a user, in one
and two stages and through an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import memory, vectors
from ..sources import tables
from ..streaming import state
from .queries import _TOKENS, _query

#: The vectors that users ask with: each the first of the user before it.
_ASKED = """asked AS (
  SELECT CAST((label + 1) % 10 AS VARCHAR) AS user_id, vec_id AS asked_id, embedding AS query FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1
), scored AS (
  SELECT user_id, e.vec_id AS id, asked_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(query AS DOUBLE[])) AS score
  FROM embeddings e JOIN asked ON user_id = CAST(e.label AS VARCHAR)
), near AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 10)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, asked_id, query): a query vector of each user."""
    w = Window.partitionBy("label").orderBy("vec_id")
    first = tables.read(spark, sf_dir, "embeddings").withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select(((F.col("label") + 1) % 10).cast("string").alias("user_id"), F.col("vec_id").alias("asked_id"), F.col("embedding").alias("query"))


@_query(f"WITH {_ASKED} SELECT user_id, id, round(score, 6) AS score, rank FROM near")
def user_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's ten nearest memories to the user's own query."""
    found = vectors.exact(tables.memories(spark, sf_dir), asked(spark, sf_dir).drop("asked_id"))
    return found.select("user_id", "id", F.round("score", 6).alias("score"), "rank")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda k: {0}[k:k + 2]))"
_LIKE = "len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"


@_query(
    f"""WITH {_ASKED}, words AS (
  SELECT user_id, id, {_TOKENS.format("lower(q.text)")}[:12] AS said, list_distinct({_TOKENS.format("lower(d.text)")}) AS known
  FROM near LEFT JOIN documents d ON d.doc_id = id LEFT JOIN documents q ON q.doc_id = asked_id
), pairs AS (
  SELECT user_id, id, k, {_GRAMS.format("w")} AS g, known FROM (SELECT user_id, id, unnest(said) AS w, unnest(range(len(said))) AS k, known FROM words)
), best AS (
  SELECT user_id, id, k, max({_LIKE.format(a="g", b=_GRAMS.format("t"))}) AS m FROM (SELECT user_id, id, k, g, unnest(known) AS t FROM pairs) GROUP BY ALL
), total AS (
  SELECT n.user_id, n.id, round(coalesce(sum(m) / max(len(said)), 0), 6) AS rerank_score
  FROM near n JOIN words USING (user_id, id) LEFT JOIN best USING (user_id, id) GROUP BY 1, 2
)
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rerank_score DESC, id) AS INTEGER) AS rank FROM total QUALIFY rank <= 5 AND rerank_score >= 0.2"""
)
def reranked_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten memories a user by cosine, ordered anew by how well their texts
    answer the query's first words; the threshold is on that second score."""
    queries, docs = asked(spark, sf_dir), tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    near = vectors.exact(tables.memories(spark, sf_dir), queries.drop("asked_id")).join(queries.select("user_id", "asked_id"), "user_id")
    said = docs.select(F.col("doc_id").alias("asked_id"), F.array_join(F.slice(memory.tokens(F.col("text"), lower=True), 1, 12), " ").alias("said"))
    told = near.join(docs.withColumnRenamed("doc_id", "id"), "id", "left").join(said, "asked_id", "left")
    score = F.round(memory.max_similarity(F.col("said"), F.col("text")), 6)
    return memory.reranked(told, score, threshold=0.2).select("user_id", "id", "rerank_score", "rank")


@_query()
def indexed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_recall`` through the inverted index over quantised vectors."""
    memories = tables.memories(spark, sf_dir)
    quantiser, path = vectors.fit(memories), f"{state.scratch(spark)}/lists"
    vectors.append(memories, quantiser, path)
    found = vectors.search(memories, asked(spark, sf_dir).drop("asked_id"), quantiser, path)
    return found.select("user_id", "id", F.round("score", 6).alias("score"), "rank")
