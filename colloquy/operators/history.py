"""Scans, paging and ownership over messages and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pages
from ..settings import SETTINGS

IN_TIME = ("created_at", "ordinal")


def bounds(page: int, size: int) -> None:
    if page < 1 or not 1 <= size <= SETTINGS.most_page_size:
        raise ValueError(f"page {page} of size {size}: page from 1, size from 1 to {SETTINGS.most_page_size}")


def first_n(messages: DataFrame, n: int, by: str = "session_id") -> DataFrame:
    """The earliest ``n`` messages of each session."""
    w = Window.partitionBy(by).orderBy(*IN_TIME)
    return messages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def last_n(messages: DataFrame, n: int, by: str = "session_id") -> DataFrame:
    """The latest ``n`` messages of each session; ``age`` counts from the newest."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in IN_TIME])
    return messages.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def of_session(messages: DataFrame, session_id: str, after=None, limit: int = 50) -> DataFrame:
    """One session, in time order, strictly after a time if one is given."""
    found = messages.where(F.col("session_id") == session_id)
    if after is not None:
        found = found.where(F.col("created_at") > F.lit(after))
    return found.orderBy(*IN_TIME).limit(limit)


def within(messages: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive bounds, each optional."""
    if start is not None:
        messages = messages.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        messages = messages.where(F.col("created_at") <= F.lit(end))
    return messages


def dialogue(messages: DataFrame) -> DataFrame:
    """Only what users and assistants said."""
    return messages.where(F.col("role").isin("user", "assistant"))


def paged(rows: DataFrame, key: str, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of each key's rows with the total; a key whose page is empty
    keeps one row with its total and nulls. Both sides use one partitioning."""
    bounds(page, size)
    w = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(w))
    chosen = ranked.where((F.col("_rank") > (page - 1) * size) & (F.col("_rank") <= page * size)).drop("_rank")
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    return totals.join(chosen, key, "left").select(
        "*", F.lit(page).cast("long").alias("page"), F.lit(size).cast("long").alias("size"), pages(F.col("total"), F.lit(size)).alias("total_page")
    )


def seek(rows: DataFrame, last: DataFrame, key: str, order: tuple[str, ...], size: int) -> DataFrame:
    """The ``size`` rows of each key that follow the last one seen: ``last``
    has the key and the ``order`` columns of that row, with no row for a key
    that is at its beginning. Pages before it are not ranked, and a window
    group limit keeps ``size`` rows a key and task before the shuffle."""
    bounds(1, size)
    seen = last.select(key, F.struct(*order).alias("_seen"))
    later = rows.join(seen, key, "left").where(F.col("_seen").isNull() | (F.struct(*order) > F.col("_seen"))).drop("_seen")
    w = Window.partitionBy(key).orderBy(*order)
    return later.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def page_of_user(sessions: DataFrame, user_id: str, page: int = 1, size: int = SETTINGS.page_size) -> DataFrame:
    """One user's sessions, newest first: a top-n, not a sort of the table."""
    bounds(page, size)
    return sessions.where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "session_id").offset((page - 1) * size).limit(size)


def session(sessions: DataFrame, session_id: str) -> DataFrame:
    """One session; a session that does not exist is an error."""
    found = sessions.where(F.col("session_id") == session_id)
    if found.isEmpty():
        raise LookupError(f"session {session_id} not found")
    return found


def owned(messages: DataFrame, sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages of sessions that were asked for by their own user."""
    granted = sessions.join(requests, ["session_id", "user_id"], "left_semi")
    return messages.join(granted, "session_id", "left_semi")


def after_summary(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages later than the session's summary; all where it has none."""
    edge = sessions.select("session_id", "summary_updated_at")
    later = F.coalesce(F.col("created_at") > F.col("summary_updated_at"), F.lit(True))
    return messages.join(edge, "session_id").where(later).drop("summary_updated_at")
