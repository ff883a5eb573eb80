"""Token usage and the model dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso, model_name, model_ratio, model_type


def usage(messages: DataFrame, owners: DataFrame, models: DataFrame) -> DataFrame:
    """Tokens of each user and model, raw and weighted; a model that is not in
    the dimension has type 3; zero usage is left out. ``models`` is a small
    dimension; Spark broadcasts it by its size."""
    per = messages.join(owners, "session_id").groupBy("user_id", "model").agg(F.sum("token_count").alias("usage_tokens")).where("usage_tokens <> 0")
    typed = per.join(models, "model", "left").withColumn("model_type", F.coalesce("model_type", F.lit(3)))
    return typed.withColumn("weighted_tokens", F.col("usage_tokens") * model_ratio(F.col("model_type")))


def usage_events(used: DataFrame, at, group_id: Column | None = None, trace_id: Column | None = None) -> DataFrame:
    """Usage as JSON for a topic, key by user; a field without a value is null."""
    none = F.lit(None).cast("string")
    body = F.to_json(
        F.struct(
            F.col("user_id").alias("userId"), (none if group_id is None else group_id).alias("groupId"), F.col("usage_tokens").alias("usageTokens"),
            (none if trace_id is None else trace_id).alias("traceId"), F.col("model_type").alias("modelType"), iso(F.lit(at)).alias("requestTime"),
        ),
        {"ignoreNullFields": "false"},
    )
    return used.select(F.col("user_id").alias("key"), body.alias("value"))


def active(models: DataFrame) -> DataFrame:
    """Models that are offered; a null flag counts as offered, its default."""
    return models.where(F.coalesce("is_active", F.lit(True)))


def catalogue(models: DataFrame, default: str) -> DataFrame:
    """Model rows with name, type, ratio and whether it is the default."""
    typed = models.withColumn("type", model_type(F.col("model")))
    return typed.select(
        "*", model_name(F.col("model")).alias("name"), model_ratio(F.col("type")).alias("ratio"), (F.col("model") == default).alias("is_default")
    )


def by_type(models: DataFrame) -> DataFrame:
    """The catalogue's three lists; the dimension is small."""
    return models.groupBy("type").agg(F.array_sort(F.collect_set("model")).alias("models"))
