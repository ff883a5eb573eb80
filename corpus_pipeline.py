"""The corpus pipeline: documents through five stages, each written as Parquet
and read again as the next one's input.

Toxic documents go, then similar lines, then all but one document of each
SimHash group, then documents that hold a benchmark item; the last stage plans
how often each document that is left is taken to reach the sources' weights.
What a stage wrote is deleted once the next stage has read it. The last stage's
rows carry no text: joined to the fourth stage's by doc_id they say how often
each is to be written out.

Defined results: null and empty texts hold no toxic token, no line and no item
and share the fingerprint zero, so one such document stays; a row without a
doc_id stays where its SimHash group has none with one, and then once; a doc_id
that repeats with different texts is a document for each; rows equal in doc_id
and text stay together; extra columns, whatever
their names, are carried as far as the fourth stage; empty tables give an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontam, linededup, mixing, simhash, toxicity
from colloquy.llm.common import discard, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The stages learn, hash and draw; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = written(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return docs
