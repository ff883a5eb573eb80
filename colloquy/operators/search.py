"""Keyword search over text: any of the keyword's words, in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import result_line, time_bounds, tokens, truncated
from ..settings import SETTINGS
from .history import first_n, within


def keyword_terms(keyword: str) -> list[str]:
    import re

    return [w for w in re.findall(r"[^\W_]+", keyword.strip().lower()) if len(w) > 1]


def matches(text: Column, keyword: str) -> Column:
    terms = keyword_terms(keyword)
    return F.arrays_overlap(tokens(text, lower=True), F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)


def matched_terms(text: Column, keyword: str) -> Column:
    """How many different terms of the keyword the text holds."""
    return F.size(F.array_intersect(tokens(text, lower=True), F.array(*[F.lit(t) for t in keyword_terms(keyword)])))


def search_messages(messages: DataFrame, keyword: str, session_id: str | None = None, start=None, end=None, limit: int = 10) -> DataFrame:
    """The earliest ``limit`` matches of each session."""
    if session_id:
        messages = messages.where(F.col("session_id") == session_id)
    return first_n(within(messages, start, end).where(matches(F.col("content"), keyword)), limit)


def rendered(found: DataFrame, by: str = "session_id") -> DataFrame:
    """One text for each session: its matches a line each, cut at the limit of
    a tool result. A session's matches are bounded by the search's limit."""
    line = result_line(F.col("role"), F.col("created_at"), F.col("content"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return found.groupBy(by).agg(truncated(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("result"))


def history_tool(messages: DataFrame, requests: DataFrame, limit: int = SETTINGS.recall_limit) -> DataFrame:
    """(request_id, output): what the history tool answers each request
    (request_id, session_id, keyword, start_time, end_time). A request without a
    session or keyword is an error text, one without a match says so. All
    requests share one join by session."""
    keyword = F.trim(F.coalesce("keyword", F.lit("")))
    start, end = time_bounds(F.col("start_time"), F.col("end_time"))
    asked = requests.select("request_id", "session_id", keyword.alias("keyword"), start.alias("start"), end.alias("end"), F.array_distinct(tokens(keyword, lower=True)).alias("terms"))
    rows = messages.select("session_id", "created_at", "ordinal", "role", "content")
    wanted = asked.where((F.size("terms") > 0) & (F.coalesce("session_id", F.lit("")) != ""))
    hit = F.arrays_overlap(tokens(F.col("content"), lower=True), F.col("terms"))
    timely = F.coalesce(F.col("created_at") >= F.col("start"), F.lit(True)) & F.coalesce(F.col("created_at") <= F.col("end"), F.lit(True))
    found = first_n(wanted.join(rows, "session_id").where(hit & timely), limit, "request_id")
    missing = F.when(F.coalesce("session_id", F.lit("")) == "", "[Tool Error] Missing session_id in execution context.").when(F.col("keyword") == "", "[Tool Error] Missing required argument: keyword.")
    none = F.concat(F.lit("[Tool Result] No messages found for keyword: '"), F.col("keyword"), F.lit("'."))
    return asked.join(rendered(found, "request_id"), "request_id", "left").select("request_id", F.coalesce(missing, "result", none).alias("output"))


#: The history tool as its schema in a registry.
HISTORY_TOOL = {
    "type": "object",
    "properties": {
        "keyword": {"type": "string", "description": "Words to look for; any of them may match."},
        "start_time": {"type": "string", "description": "Earliest time, ISO-8601."},
        "end_time": {"type": "string", "description": "Latest time, ISO-8601."},
        "limit": {"type": "integer", "description": "Most messages to return.", "default": SETTINGS.recall_limit},
    },
    "required": ["keyword"],
}
