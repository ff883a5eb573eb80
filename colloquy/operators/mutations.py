"""Changes to sessions, messages and memories as set operations, and sinks.

Plain Parquet has no MERGE: a change is a table of changes, and the current
state is the latest row of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key, by ``at``, of equal times the greatest by its
    other columns; aggregated map-side."""
    others = F.struct(*[c for c in rows.columns if c != key])
    packed = rows.groupBy(key).agg(F.max_by(others, F.struct(at, F.to_json(others))).alias("_row"))
    return packed.select(key, "_row.*").select(*rows.columns)


def updated(sessions: DataFrame, changes: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions with the latest change of each laid over: ``changes`` has the
    key, ``changed_at`` and any of the session's columns; a null leaves what
    was there, of equal times the greater value counts, and a change of an
    unknown session does nothing."""
    fields = [c for c in changes.columns if c not in (key, "changed_at")]
    newest = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("changed_at", c))).alias(f"_{c}") for c in fields])
    laid = {c: F.coalesce(f"_{c}", c) for c in fields}
    return sessions.join(newest, key, "left").select(*[laid[c].alias(c) if c in laid else F.col(c) for c in sessions.columns])


def deleted(sessions: DataFrame, deletions: DataFrame) -> DataFrame:
    """Without the sessions that their own user deleted. Messages stay."""
    return sessions.join(deletions, ["session_id", "user_id"], "left_anti")


def pinned_first(sessions: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("is_pinned"), F.desc_nulls_last("pinned_at"), F.desc("updated_at"), "session_id")
    return sessions.withColumn("place", F.row_number().over(w))


def append(rows: DataFrame, path: str, key: str = "session_id") -> None:
    """Bulk append; each file is in order of ``key``, so that a point read skips
    most row groups by their statistics."""
    rows.sortWithinPartitions(key).write.mode("append").parquet(path)


def send(rows: DataFrame, topic: str, servers: str | None = None, path: str | None = None, headers: dict[str, str] | None = None) -> None:
    """(key, value) to a Kafka topic where a connector is installed and servers
    are named, else as JSON files."""
    if servers:
        pairs = [F.struct(F.lit(k).alias("key"), F.lit(v).cast("binary").alias("value")) for k, v in (headers or {}).items()]
        out = rows.withColumn("headers", F.array(*pairs)) if pairs else rows
        out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("includeHeaders", "true").save()
    else:
        rows.write.mode("append").json(f"{path}/{topic}")
