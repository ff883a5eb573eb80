"""A stored inverted index over messages or documents.

A posting is (term, owner, time, ordinal, rank), ``rank`` being its place among
the term's postings of its owner in that append. Postings lie in folders by a
hash of the term; within a file they are sorted by term, then rank, so a search
prunes to the folders of its terms and, by the files' statistics, to the row
groups that hold them. A search for an owner's first ``k`` matches needs only
postings of rank ``k`` or less: a match among the first k of all terms is among
the first k of each of its own. Appends add files; their ranks are of the
append alone, which can only be too low, so what is needed is still read.
``compact`` writes an index anew with ranks over all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .history import IN_TIME, within
from .search import keyword_terms

BUCKETS = 64
_SCHEMA = "term string, owner string, created_at timestamp_ntz, ordinal long, rank int, bucket int"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, owner: str = "session_id", text: str = "content") -> DataFrame:
    """(term, owner, created_at, ordinal) of every different term of each row."""
    terms = F.explode(F.array_distinct(tokens(F.col(text), lower=True))).alias("term")
    return rows.select(F.col(owner).cast("string").alias("owner"), "created_at", F.col("ordinal").cast("long").alias("ordinal"), terms)


def _ranked(found: DataFrame) -> DataFrame:
    """An owner's rows are what a term's window holds, so no term's postings
    meet in one task, however frequent it is."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("owner", "term").orderBy(*IN_TIME)))


def _write(found: DataFrame, path: str, mode: str, file_rows: int) -> None:
    """Postings by bucket. What a bucket holds is known after the shuffle only:
    there a large bucket is dealt over tasks, so no pass is needed to count."""
    placed = found.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "rank")
    placed.write.mode(mode).option("parquet.block.size", 8 << 20).option("maxRecordsPerFile", file_rows).partitionBy("bucket").parquet(path)


def append(rows: DataFrame, path: str, owner: str = "session_id", text: str = "content", file_rows: int = 5_000_000, single: bool = False) -> None:
    """Add the postings of ``rows`` to the index at ``path``; a row may be
    added once only. Where owners are ``single`` rows, a posting is its owner's
    first of its term, and nothing needs to be ranked."""
    found = postings(rows, owner, text)
    _write(found.withColumn("rank", F.lit(1)) if single else _ranked(found), path, "append", file_rows)


def compact(spark: SparkSession, path: str, to: str, file_rows: int = 5_000_000) -> None:
    """The index at ``path`` as few sorted files at ``to``."""
    _write(_ranked(stored(spark, path).drop("rank", "bucket")), to, "errorifexists", file_rows)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def _buckets_of(spark: SparkSession, terms: list[str]) -> list[int]:
    rows = spark.createDataFrame([(t,) for t in terms], "term string")
    return sorted({r["b"] for r in rows.select(_bucket(F.col("term")).alias("b")).collect()})


def lookup(spark: SparkSession, path: str, keyword: str, most_rank: int | None = None) -> DataFrame:
    """The postings of any of the keyword's terms."""
    terms = keyword_terms(keyword)
    found = stored(spark, path)
    if not terms:
        return found.limit(0)
    found = found.where(F.col("bucket").isin(_buckets_of(spark, terms)) & F.col("term").isin(terms))
    return found if most_rank is None else found.where(F.col("rank") <= most_rank)


def search(spark: SparkSession, path: str, keyword: str, owner: str | None = None, start=None, end=None, limit: int = 10) -> DataFrame:
    """(owner, created_at, ordinal, matched, rank): the earliest ``limit``
    matches of each owner, with how many of the keyword's terms each holds.
    Time bounds may leave out early postings, so then all ranks are read."""
    found = lookup(spark, path, keyword, limit if start is None and end is None else None)
    if owner is not None:
        found = found.where(F.col("owner") == owner)
    rows = within(found, start, end).groupBy("owner", "created_at", "ordinal").agg(F.count("*").cast("int").alias("matched"))
    w = Window.partitionBy("owner").orderBy(*IN_TIME)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def documents(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """(owner, matched): every owner that holds a term, for an index whose
    owners are single rows."""
    return lookup(spark, path, keyword).groupBy("owner").agg(F.count("*").cast("int").alias("matched"))
