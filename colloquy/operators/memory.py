"""Vector recall for each user, and edits of the memory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..settings import SETTINGS


def cosine(a: Column, b: Column) -> Column:
    """In double; null where a vector is empty or all zero."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(wide(a), wide(b), lambda x, y: x * y))
    norm = lambda v: F.sqrt(total(F.transform(wide(v), lambda x: x * x)))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size)


def recall(memories: DataFrame, query: list[float], limit: int = SETTINGS.recall_limit, threshold: float | None = SETTINGS.recall_score) -> DataFrame:
    """Each user's ``limit`` nearest items to one query, then the threshold.
    Spark's window group limit keeps a heap, not a user's rows, before the
    shuffle."""
    scored = memories.withColumn("score", F.coalesce(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), F.lit(0.0)))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "id")
    found = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return found if threshold is None else found.where(F.col("score") >= threshold)


def _grams(word: Column, n: int = 3) -> Column:
    """The different stretches of ``n`` characters; a shorter word is one."""
    size = F.greatest(F.length(word) - (n - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda k: F.substring(word, k, n)))


def max_similarity(query: Column, text: Column) -> Column:
    """How well a text answers a query, 0 to 1: for each of the query's words
    the likeness of the text's word nearest to it, averaged. Two words are as
    like as their character trigrams are shared; all in the JVM."""
    known = F.array_distinct(tokens(text, lower=True))
    like = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    grams = F.transform(known, lambda w: _grams(w))
    best = F.transform(tokens(query, lower=True), lambda w: F.coalesce(F.array_max(F.transform(grams, lambda g: like(_grams(w), g))), F.lit(0.0)))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.when(F.size(best) > 0, total / F.size(best)), F.lit(0.0))


def reranked(found: DataFrame, score: Column, limit: int = SETTINGS.rerank_limit, threshold: float | None = None, by: str = "user_id") -> DataFrame:
    """The second stage: what the first stage found ordered anew by a score of
    its own, ``rerank_score``, of which ``limit`` stay; a threshold is on that
    score too. ``score`` may be any column: ``max_similarity``, or a Pandas UDF
    that asks a model."""
    scored = found.drop("rank").withColumn("rerank_score", score)
    w = Window.partitionBy(by).orderBy(F.desc("rerank_score"), "id")
    kept = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return kept if threshold is None else kept.where(F.col("rerank_score") >= threshold)


def listed(memories: DataFrame) -> DataFrame:
    """Each user's whole store as its public fields; no metadata is an empty map."""
    none = F.create_map().cast("map<string,string>")
    metadata = F.coalesce("metadata", none) if "metadata" in memories.columns else none
    return memories.select("user_id", F.col("id").cast("string").alias("id"), "memory", metadata.alias("metadata"))


def facts(found: DataFrame) -> DataFrame:
    """A bulleted list of each user's recalled memories."""
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.coalesce("memory", F.lit(""))).alias("line"))))
    return found.groupBy("user_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("facts"))


def without(memories: DataFrame, deletions: DataFrame) -> DataFrame:
    """Owner-checked deletes: a deletion by another user does nothing."""
    return memories.join(deletions, ["id", "user_id"], "left_anti")


def without_users(memories: DataFrame, users: DataFrame) -> DataFrame:
    return memories.join(users, "user_id", "left_anti")
