"""Readers, and the chat views derived from the given tables.

Times are TIMESTAMP_NTZ, as the tables hold them; streams cast to TIMESTAMP.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..settings import SETTINGS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_strict(spark: SparkSession, path: str, schema: StructType, kind: str = "json") -> DataFrame:
    """Rows of a declared schema; a malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").format(kind).load(path)


def token_estimate(content: str = "content"):
    """Characters div 4; null content counts 0."""
    return F.coalesce(F.expr(f"length({content}) div {SETTINGS.chars_per_token}"), F.lit(0).cast("long"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each message of ``conversations``."""
    minutes = "make_dt_interval(0, 0, cast(conv_id * 60 + turn as int), 0)"
    return (
        read(spark, sf_dir, "conversations")
        .withColumn("content", F.col("text"))
        .select(
            F.col("conv_id").cast("string").alias("session_id"),
            F.col("turn").alias("ordinal"),
            "role",
            "content",
            token_estimate().alias("token_count"),
            F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + {minutes}").alias("created_at"),
            "conv_id",
        )
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conversation, with its owner and summary boundary."""
    per = messages(spark, sf_dir).groupBy("conv_id", "session_id").agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return per.select(
        "session_id",
        (F.col("conv_id") % 10).cast("string").alias("user_id"),
        F.lit("New Chat").alias("title"),
        "created_at",
        "updated_at",
        F.expr("CASE WHEN conv_id % 3 <> 0 THEN created_at + INTERVAL '2' MINUTE END").alias("summary_updated_at"),
        F.expr("CASE WHEN conv_id % 3 <> 0 THEN concat('Summary of ', session_id) END").alias("current_summary"),
        "conv_id",
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as per-user memory items."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("string").alias("user_id"),
        F.concat(F.lit("memory "), F.col("vec_id").cast("string")).alias("memory"),
        "embedding",
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as streamed fragments: a call for each user, in time order."""
    return fragments_of(read(spark, sf_dir, "events"))


def fragments_of(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as fragments."""
    return events.select(
        F.col("user_id").alias("call"),
        F.expr("unix_micros(cast(ts as timestamp))").alias("seq"),
        F.expr("cast(event_id % 2 as int)").alias("index"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN concat('call_', event_id) ELSE '' END").alias("id"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN event_type END").alias("name"),
        F.col("props").alias("arguments"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN concat(event_type, ' ') END").alias("content"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN 'tool_calls' END").alias("finish_reason"),
        "event_id",
    )
