"""Prompt and summary texts, assembled for all sessions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headings of the parts; the instructions are parameters.
FACTS_HEADING = "[Relevant User Memories]:"
SUMMARY_HEADING = "[Conversation Summary so far]:"
EARLIER_HEADING = "[Existing Summary of earlier conversation]:"
LATER_HEADING = "[New conversation to incorporate]:"
ASSISTANT = "You are a helpful assistant. Use the retrieved context where it is relevant."
SUMMARISE = "Write one updated summary of the earlier summary and the new conversation."
SELECTION = "<selected_text>\n%s\n</selected_text>\n\n<user_query>\n%s\n</user_query>"


def transcript(messages: DataFrame, by: str = "session_id") -> DataFrame:
    """``role: content`` lines of each session in time order; null content is
    the empty string. A session's lines are one value, as a summariser reads
    them: what one prompt can hold bounds it, not the table."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("content", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("created_at", "ordinal", line.alias("line"))))
    return messages.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def summary_input(windowed: DataFrame, sessions: DataFrame, instruction: str = SUMMARISE, only_flagged: bool = False) -> DataFrame:
    """What a summariser reads: the earlier summary if there is one, the
    messages that leave the window, and the instruction."""
    leaving = windowed.where("bucket = 'compress'")
    if only_flagged:
        leaving = leaving.where("needs_compression")
    text = transcript(leaving).join(sessions.select("session_id", "current_summary"), "session_id", "left")
    earlier = F.when(F.col("current_summary") != "", F.concat(F.lit(EARLIER_HEADING + "\n"), F.col("current_summary")))
    later = F.concat(F.lit(LATER_HEADING + "\n"), F.col("transcript"))
    return text.select("session_id", F.concat_ws("\n\n", earlier, later, F.lit(instruction)).alias("prompt"))


def system_prompt(facts: Column, instruction: str = ASSISTANT) -> Column:
    extra = F.when(F.coalesce(facts, F.lit("")) != "", F.concat(F.lit("\n" + FACTS_HEADING + "\n"), facts, F.lit("\n")))
    return F.concat(F.lit(instruction + "\n"), F.coalesce(extra, F.lit("")))


def selected_text(query: Column, selection: Column) -> Column:
    """The query, wrapped with the selection where there is one."""
    return F.when(F.coalesce(selection, F.lit("")) != "", F.format_string(SELECTION, selection, query)).otherwise(query)


def first_selection(states: Column) -> Column:
    """The value of the first state with key ``selected_text`` not disabled."""
    wanted = F.filter(states, lambda s: (s["key"] == "selected_text") & ~F.coalesce(s["disabled"], F.lit(False)))
    return F.get(wanted, 0)["value"]


def assemble(windowed: DataFrame, sessions: DataFrame, facts: DataFrame, query: Column) -> DataFrame:
    """(session_id, position, role, content): system prompt, summary where
    there is one, the kept messages oldest first, then the query."""
    head = sessions.join(facts, "user_id", "left")
    system = head.select("session_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("ordinal"), F.lit("system").alias("role"), system_prompt(F.col("facts")).alias("content"))
    summary = head.where("coalesce(current_summary, '') <> ''").select(
        "session_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("ordinal"), F.lit("system").alias("role"),
        F.concat(F.lit(SUMMARY_HEADING + "\n"), F.col("current_summary")).alias("content"),
    )
    kept = windowed.where("bucket = 'keep'").select("session_id", F.lit(2).alias("part"), "ordinal", "role", "content")
    asked = sessions.select("session_id", F.lit(3).alias("part"), F.lit(0).cast("long").alias("ordinal"), F.lit("user").alias("role"), query.alias("content"))
    return system.unionByName(summary).unionByName(kept).unionByName(asked)
