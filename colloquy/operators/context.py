"""Context windows: token budgets, hot copies and cold storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SETTINGS
from .history import IN_TIME, after_summary, last_n


def window(messages: DataFrame, low: int = SETTINGS.low_budget, high: int = SETTINGS.high_budget) -> DataFrame:
    """Each message with the tokens from it to the newest, whether it is kept
    (``keep``) or summarised (``compress``), and whether its session is over
    the high mark. One shuffle serves both windows."""
    newest = Window.partitionBy("session_id").orderBy(*[F.desc(c) for c in IN_TIME]).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("session_id")
    n = F.coalesce("token_count", F.lit(0).cast("long"))
    return messages.select(
        "*",
        F.sum(n).over(newest).alias("tokens_from_here"),
        (F.sum(n).over(every) >= high).alias("needs_compression"),
    ).withColumn("bucket", F.when(F.col("tokens_from_here") <= low, "keep").otherwise("compress"))


def over_budget(messages: DataFrame, high: int = SETTINGS.high_budget) -> DataFrame:
    """(session_id, total_tokens, needs_compression), by partial sums."""
    total = messages.groupBy("session_id").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("total_tokens"))
    return total.withColumn("needs_compression", F.col("total_tokens") >= high)


def hot(messages: DataFrame, n: int = SETTINGS.hot_messages) -> DataFrame:
    """The capped recent list of each session."""
    return last_n(messages, n)


def replaced(hot_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """``hot_rows`` in which the sessions of ``rows`` hold just these; a
    session without rows keeps its list."""
    columns = [c for c in hot_rows.columns if c in rows.columns]
    stay = hot_rows.select(*columns).join(rows.select("session_id").distinct(), "session_id", "left_anti").select(*columns)
    return stay.unionByName(rows.select(*columns))


def hot_or_cold(messages: DataFrame, sessions: DataFrame, hot_rows: DataFrame, cold_n: int = SETTINGS.cold_messages) -> DataFrame:
    """A session's hot list if it has one, else the last messages after its
    summary from cold storage. One window over both tells which it is."""
    columns = ["session_id", "ordinal", "role", "content"]
    cold = last_n(after_summary(messages, sessions), cold_n)
    both = hot_rows.select(*columns, F.lit("hot").alias("origin")).unionByName(cold.select(*columns, F.lit("cold").alias("origin")))
    is_hot = F.col("origin") == "hot"
    return both.withColumn("any_hot", F.max(is_hot).over(Window.partitionBy("session_id"))).where(is_hot == F.col("any_hot")).drop("any_hot")


def inactivity(writes: DataFrame, key: str, at: str, gap: str = "24 hours") -> DataFrame:
    """Spans in which a key's list lives: a write resets its time to live."""
    return writes.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("writes")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "writes")
