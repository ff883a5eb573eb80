"""Queries of the tool loop, of tools as table functions, and of turns that
never end."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tools as T
from ..operators import loop
from ..sources import tables, topics
from ..streaming import state
from .queries import _query
from .views import MESSAGES


def _scripted(messages: list[dict]) -> tuple[str | None, list[tuple[str, str, str]]]:
    """A model that calls a tool as often as its first message asks."""
    wanted, seen = int(messages[0]["content"]), [m for m in messages if m["role"] == "tool"]
    if len(seen) < wanted:
        return "", [(f"call_{len(seen)}", "double", json.dumps({"n": len(seen)}))]
    return f"done: {seen[-1]['content'] if seen else 'nothing'}", []


def _double(arguments: dict) -> str:
    n = int(arguments["n"])
    if n == 3:
        raise ValueError("three")
    return str(2 * n)


@_query(
    f"""WITH c AS (SELECT conv_id AS turn, conv_id % 8 AS wanted FROM conversations GROUP BY ALL), s AS (
  SELECT turn, wanted, unnest(range(least(wanted, 5))) AS k FROM c
), o AS (SELECT *, CASE WHEN k = 3 THEN '[Tool Execution Error]: ValueError: three' ELSE CAST(2 * k AS VARCHAR) END AS output FROM s)
SELECT turn, 2 * k AS position, 'assistant' AS role, CAST(NULL AS VARCHAR) AS content, 'call_' || k AS calls, CAST(NULL AS VARCHAR) AS name FROM o
UNION ALL SELECT turn, 2 * k + 1, 'tool', output, 'call_' || k, 'double' FROM o
UNION ALL SELECT c.turn, 2 * least(c.wanted, 5), 'assistant', CASE WHEN c.wanted >= 5 THEN '{loop.EXHAUSTED.format(5)}' ELSE 'done: ' || coalesce(o.output, 'nothing') END, '', NULL
FROM c LEFT JOIN o ON o.turn = c.turn AND o.k = c.wanted - 1 AND c.wanted < 5"""
)
def tool_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of every conversation with a model that follows a script."""
    turns = tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("turn")).distinct()
    asked = F.array(loop._message("user", (F.col("turn") % 8).cast("string")))
    done = loop.loop(turns.withColumn("history", asked), _scripted, {"double": _double}, f"{state.scratch(spark)}/loop")
    each = done.select("turn", F.posexplode("messages").alias("position", "m"))
    ids = F.coalesce("m.tool_call_id", F.array_join(F.transform("m.tool_calls", lambda c: c["id"]), ","), F.lit(""))
    return each.select("turn", F.col("position").cast("long").alias("position"), "m.role", "m.content", ids.alias("calls"), "m.name")


WORDS_TOOL = {
    "type": "object",
    "properties": {"text": {"type": "string", "description": "What to look at."}, "least": {"type": "integer", "description": "Letters of a word that counts."}},
    "required": ["text"],
}


def _long_words(context: dict, arguments: dict) -> str:
    n = sum(len(w) >= arguments.get("least", 1) for w in arguments["text"].split(" "))
    return f"{context['session_id']}: {n}"


@_query(
    f"""WITH {MESSAGES}
SELECT session_id, ordinal AS call_id, CASE WHEN content IS NULL THEN '[Tool Error] Missing required argument: text.'
  ELSE session_id || ': ' || len(list_filter(string_split(content, ' '), lambda w: length(w) >= 5)) END AS output FROM messages"""
)
def tool_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool called from SQL for every message, bound to its session."""
    T.register_tool(spark, "long_words", WORDS_TOOL, _long_words)
    tables.messages(spark, sf_dir).createOrReplaceTempView("tool_calls_asked")
    return spark.sql(
        "SELECT * FROM long_words(TABLE(SELECT session_id, ordinal AS call_id, content AS text, 5L AS least FROM tool_calls_asked) PARTITION BY session_id)"
    )


_TURNS = """starts AS (SELECT event_id AS turn, ts AS started_at, event_type FROM events WHERE event_id % 2 = 0),
ends AS (SELECT event_id - 1 AS turn, ts AS ended_at FROM events WHERE event_id % 2 = 1 AND event_type <> 'error')"""


@_query(
    f"""WITH {_TURNS}, mark AS (
  SELECT least((SELECT max(started_at) FROM starts), (SELECT max(ended_at) FROM ends)) - INTERVAL 1 HOUR AS mark
), j AS (SELECT s.turn, started_at, ended_at FROM starts s LEFT JOIN ends e ON e.turn = s.turn AND ended_at BETWEEN started_at AND started_at + INTERVAL 6 HOUR)
SELECT turn, CASE WHEN ended_at IS NULL THEN 'aborted' ELSE 'finished' END AS outcome FROM j, mark WHERE ended_at IS NOT NULL OR started_at + INTERVAL 6 HOUR < mark"""
)
def turn_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns finished in time and which are aborted, from two streams."""
    path = f"{sf_dir}/events.parquet"
    events = lambda: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))
    starts = events().where("event_id % 2 = 0").select(F.col("event_id").alias("turn"), F.col("ts").alias("started_at"))
    ends = events().where("event_id % 2 = 1 AND event_type <> 'error'").select((F.col("event_id") - 1).alias("turn"), F.col("ts").alias("ended_at"))
    return state.appended(state.outcomes(starts, ends, "6 hours", "1 hour")).select("turn", "outcome")


@_query(
    f"""WITH {MESSAGES}
SELECT session_id AS key, ordinal, token_count AS tokens, 'usage' AS kind FROM messages WHERE token_count > 0"""
)
def topic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message's usage sent by a stream to a topic, and read from it."""
    root = state.scratch(spark)
    said = state.message_stream(spark, sf_dir).where("token_count > 0")
    value = F.to_json(F.struct("ordinal", F.col("token_count").alias("tokens")))
    topics.send(said.select(F.col("session_id").alias("key"), value.alias("value")), root, "usage", f"{root}/log", {"kind": "usage"})
    got = state.appended(topics.read(spark, root, "usage", stream=True))
    fields = F.from_json("value", "ordinal long, tokens long")
    return got.select("key", fields.alias("v"), F.col("headers")["kind"].alias("kind")).select("key", "v.ordinal", "v.tokens", "kind")
