"""Queries of what happens in and after a turn: tools, frames, wire messages,
summaries and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytepairs, frames, segmentation
from ..functions import text as T
from ..operators import context, fragments, history, hooks, index, memory, metering, mutations, prompts, search
from ..settings import SETTINGS, overlaid
from ..sources import tables
from ..streaming import processors, state
from .queries import _DELTAS, _KIND_OF, _MODEL_OF, _TERMS, _TOKENS, KEYWORD, _models, _query
from .views import MESSAGES, SESSIONS, WINDOWED, iso

_LAST_FIVE = "row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, ordinal DESC) <= 5"


@_query(
    f"""WITH {WINDOWED}, k AS (SELECT * FROM windowed WHERE needs_compression AND bucket = 'keep')
SELECT session_id, ordinal, role, content FROM k
UNION ALL SELECT session_id, ordinal, role, content FROM (SELECT * FROM messages QUALIFY {_LAST_FIVE}) WHERE session_id NOT IN (SELECT session_id FROM k)"""
)
def hot_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot lists after a compression: what was kept takes their place."""
    messages = tables.messages(spark, sf_dir)
    kept = context.window(messages).where("needs_compression AND bucket = 'keep'")
    columns = ["session_id", "ordinal", "role", "content"]
    return context.replaced(context.hot(messages, 5).select(*columns), kept.select(*columns))


@_query(
    f"""WITH {SESSIONS}, o AS (SELECT {_MODEL_OF} AS model, max(conv_id) % 2 = 0 AS even FROM sessions GROUP BY 1)
SELECT model, {_KIND_OF} AS type FROM o WHERE even OR model = 'custom-model-x'"""
)
def active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offered models; one model has no flag and counts as offered."""
    owners = tables.sessions(spark, sf_dir).select(F.expr(_MODEL_OF).alias("model"), "conv_id")
    flag = F.when(F.col("model") != "custom-model-x", F.max("conv_id") % 2 == 0)
    models = owners.groupBy("model").agg(flag.alias("is_active"))
    return metering.catalogue(metering.active(models), SETTINGS.default_model).select("model", "type")


@_query(
    """SELECT event_id, 'tool' AS role, event_type AS content, event_id % 2 = 0 AS has_calls, event_id % 3 = 0 AS has_call_id, event_id % 5 = 0 AS has_name,
       CASE WHEN event_id % 2 = 0 THEN 'call_' || event_id END AS first_call FROM events"""
)
def wire_tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider messages whose optional keys are set, empty or null by turns;
    null and empty ones are left out."""
    n = F.col("event_id")
    call = F.struct(F.concat(F.lit("call_"), n.cast("string")).alias("id"), F.lit("function").alias("type"))
    rows = tables.read(spark, sf_dir, "events").select(
        n, F.lit("tool").alias("role"), F.col("event_type").alias("content"),
        F.when(n % 2 == 0, F.array(call)).when(n % 4 == 1, F.filter(F.array(call), lambda _: F.lit(False))).alias("tool_calls"),
        F.when(n % 3 == 0, F.lit("x")).when(n % 3 == 1, F.lit("")).alias("tool_call_id"),
        F.when(n % 5 == 0, F.lit("x")).when(n % 5 == 1, F.lit("")).alias("name"),
    )
    fields = F.from_json("wire", "role string, content string, tool_calls array<struct<id:string>>").alias("w")
    has = lambda key: F.array_contains(F.json_object_keys("wire"), key)
    found = fragments.wire(rows).select(n, fields, has("tool_calls").alias("has_calls"), has("tool_call_id").alias("has_call_id"), has("name").alias("has_name"))
    return found.select("event_id", "w.role", "w.content", "has_calls", "has_call_id", "has_name", F.get("w.tool_calls", 0)["id"].alias("first_call"))


_KINDS = list(frames.FIELDS)


@_query(
    f"""WITH k AS (SELECT event_id, event_type, {_KINDS!r}[event_id % {len(_KINDS) + 2} + 1] AS kind FROM events)
SELECT event_id, CASE WHEN event_id % {len(_KINDS) + 2} = {len(_KINDS)} THEN 'data-note' WHEN event_id % {len(_KINDS) + 2} = {len(_KINDS) + 1} THEN '[DONE]' ELSE kind END AS type,
  CASE {" ".join(f"WHEN kind = '{k}' THEN '{','.join(sorted(f))}'" for k, f in frames.FIELDS.items() if f)} WHEN event_id % {len(_KINDS) + 2} = {len(_KINDS)} THEN 'data' ELSE '' END AS fields,
  CASE WHEN kind IN ({", ".join(f"'{k}'" for k, f in frames.FIELDS.items() if f)}) OR event_id % {len(_KINDS) + 2} = {len(_KINDS)} THEN event_type END AS value
FROM k"""
)
def frame_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of frame, the data frame and the end mark by turns, read back
    as type, other fields and a field's value."""
    n, kinds = F.col("event_id") % (len(_KINDS) + 2), list(frames.FIELDS.items())
    text = F.lit(None)
    for i, (kind, names) in enumerate(kinds):
        text = F.when(n == i, frames.frame(kind, **{x: F.col("event_type") for x in names})).otherwise(text)
    text = F.when(n == len(kinds), frames.data_frame("note", F.col("event_type"))).when(n == len(kinds) + 1, frames.done()).otherwise(text)
    body = F.regexp_extract("frame", r"(?s)^data: (.*)\n\n$", 1)
    made = tables.read(spark, sf_dir, "events").select("event_id", text.alias("frame")).select("event_id", body.alias("body"))
    keys = F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>"))
    values = F.from_json("body", "map<string,string>")
    other = F.array_sort(F.filter(keys, lambda k: k != "type"))
    return made.select(
        "event_id", F.coalesce(F.get_json_object("body", "$.type"), "body").alias("type"), F.array_join(other, ",").alias("fields"),
        F.try_element_at(values, F.get(other, 0)).alias("value"),
    )


@_query(
    f"""WITH {_DELTAS}
SELECT call, coalesce(string_agg(content, '' ORDER BY seq, content), '') AS content FROM d GROUP BY call HAVING count(finish_reason) > 0"""
)
def stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of the calls that have ended, from a stream of fragments."""
    versions = state.appended(state.assembled_text(state.delta_stream(spark, sf_dir)))
    return mutations.latest(versions, "call", "version").select("call", "content")


@_query(
    f"""WITH {_DELTAS}, n AS (
  SELECT *, coalesce(sum(CASE WHEN finish_reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY call ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS completion,
         sum(CASE WHEN finish_reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY call) AS ends
  FROM d
), t AS (
  SELECT call, completion, coalesce(string_agg(content, '' ORDER BY seq, event_id), '') AS content, max(finish_reason) AS finish_reason FROM n WHERE completion < ends GROUP BY ALL
), c AS (
  SELECT call, completion, index, coalesce(max_by(id, (seq, event_id)) FILTER (WHERE id <> ''), '') AS id, coalesce(string_agg(name, '' ORDER BY seq, event_id), '') AS name,
         coalesce(string_agg(arguments, '' ORDER BY seq, event_id), '') AS arguments
  FROM n WHERE completion < ends GROUP BY ALL
)
SELECT t.call, CAST(t.completion AS BIGINT) AS completion, content, finish_reason, string_agg(id, ',' ORDER BY index) AS ids, string_agg(name, ',' ORDER BY index) AS names,
       string_agg(arguments, '|' ORDER BY index) AS arguments
FROM t JOIN c USING (call, completion) GROUP BY ALL"""
)
def stream_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and tool calls of each completion, from a stream of fragments."""
    found = state.appended(processors.completions(state.delta_stream(spark, sf_dir)))
    joined = lambda field, by: F.array_join(F.transform("tool_calls", lambda c: c[field]), by)
    return found.select("call", "completion", "content", "finish_reason", joined("id", ",").alias("ids"), joined("name", ",").alias("names"), joined("arguments", "|").alias("arguments"))


@_query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'vendor/m' || c_nationkey ELSE 'openai/m' || c_nationkey END AS model, 'hot:' || c_custkey AS hot_key,
       CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE 'New Chat' END AS title, '[Tool Execution Error]: ValueError: ' || c_name AS error FROM customer"""
)
def small_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixed model ids, store keys, defaulted titles and error texts."""
    n, m = F.col("c_custkey"), F.concat(F.lit("m"), F.col("c_nationkey").cast("string"))
    title = F.when(n % 3 == 2, F.col("c_mktsegment")).when(n % 3 == 1, F.lit(""))
    return tables.read(spark, sf_dir, "customer").select(
        n, T.prefixed(F.when(n % 2 == 0, F.concat(F.lit("vendor/"), m)).otherwise(m)).alias("model"), T.hot_key(n.cast("string")).alias("hot_key"),
        T.defaulted(title, "New Chat").alias("title"), T.tool_error(F.lit("ValueError"), F.col("c_name")).alias("error"),
    )


@_query(
    f"""WITH {MESSAGES}, l AS (SELECT session_id, list(ordinal ORDER BY ordinal) AS o FROM messages GROUP BY 1)
SELECT session_id, array_to_string(o[3:], ',') AS new_ordinals, len(o[3:]) AS n_new FROM l"""
)
def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turn added to each session's list of two."""
    lists = tables.messages(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list("ordinal")).alias("o"))
    new = fragments.appended(F.col("o"), F.lit(2))
    return lists.select("session_id", F.array_join(F.transform(new, lambda x: x.cast("string")), ",").alias("new_ordinals"), F.size(new).cast("long").alias("n_new"))


@_query(
    f"""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS selection,
       CASE WHEN c_custkey % 3 <> 0 THEN format('{prompts.SELECTION.replace("%s", "{}")}', c_mktsegment, c_name) ELSE c_name END AS query FROM customer"""
)
def selected_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries wrapped with the first selection that is not disabled."""
    one = lambda key, off, value: F.struct(F.lit(key).alias("key"), off.alias("disabled"), value.alias("value"))
    n = F.col("c_custkey")
    states = F.array(one("other", F.lit(False), F.col("c_name")), one("selected_text", F.lit(True), F.lit("off")), one("selected_text", F.when(n % 3 == 0, F.lit(True)).when(n % 3 == 1, F.lit(False)), F.col("c_mktsegment")))
    chosen = prompts.first_selection(states)
    return tables.read(spark, sf_dir, "customer").select("c_custkey", chosen.alias("selection"), prompts.selected_text(F.col("c_name"), chosen).alias("query"))


def _answer(prompt: str) -> str:
    """A stand-in for a model that SQL can follow."""
    if len(prompt) % 7 == 0:
        raise RuntimeError("no answer")
    return " " if len(prompt) % 5 == 0 else f" Summary of {len(prompt)} characters"


_PROMPTS = f"""t AS (
  SELECT session_id, string_agg(role || ': ' || coalesce(content, ''), chr(10) ORDER BY created_at, ordinal) AS t, max(ordinal) AS summary_ordinal
  FROM windowed WHERE bucket = 'compress' AND needs_compression GROUP BY 1
), p AS (
  SELECT session_id, summary_ordinal, length(concat_ws(chr(10) || chr(10), CASE WHEN current_summary <> '' THEN '{prompts.EARLIER_HEADING}' || chr(10) || current_summary END,
    '{prompts.LATER_HEADING}' || chr(10) || t, '{prompts.SUMMARISE}')) AS n FROM t LEFT JOIN sessions USING (session_id)
)"""


@_query(
    f"""WITH {WINDOWED}, {_PROMPTS}
SELECT session_id, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN ' ' ELSE ' Summary of ' || n || ' characters' END AS answer,
       CASE WHEN n % 7 = 0 THEN 'RuntimeError: no answer' END AS error FROM p"""
)
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's summary prompt sent to a model; failures stay in their row."""
    asked = prompts.summary_input(context.window(tables.messages(spark, sf_dir)), tables.sessions(spark, sf_dir), only_flagged=True)
    return hooks.completed(asked, _answer).select("session_id", "answer", "error")


@_query(
    f"""WITH {WINDOWED}, {_PROMPTS}
SELECT s.session_id, coalesce('Summary of ' || p.n || ' characters', s.current_summary) AS current_summary, p.summary_ordinal,
       {iso("coalesce(CASE WHEN p.n IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' END, s.summary_updated_at)")} AS summary_updated_at,
       (SELECT count(*) FROM windowed w WHERE w.session_id = s.session_id AND bucket = 'keep' AND p.n IS NOT NULL) AS n_hot
FROM sessions s LEFT JOIN (SELECT * FROM p WHERE n % 7 <> 0 AND n % 5 <> 0) p USING (session_id)"""
)
def compressed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summarise and compress every session over its mark, end to end: new
    summaries laid over the sessions, and the size of each reloaded hot list."""
    sessions = tables.sessions(spark, sf_dir).withColumn("summary_ordinal", F.lit(None).cast("long"))
    at = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    changes, kept = state.compressed(tables.messages(spark, sf_dir), sessions, _answer, at)
    now = mutations.updated(sessions, changes)
    sizes = kept.groupBy("session_id").agg(F.count("*").alias("n_hot"))
    return now.join(sizes, "session_id", "left").select(
        "session_id", "current_summary", "summary_ordinal", T.iso(F.col("summary_updated_at")).alias("summary_updated_at"), F.coalesce("n_hot", F.lit(0).cast("long")).alias("n_hot")
    )


@_query(
    f"""WITH {SESSIONS}, n AS (SELECT session_id, count(*) AS c FROM messages GROUP BY 1)
SELECT session_id, trim('  of ' || c || ' ') AS current_summary FROM n JOIN sessions USING (session_id) WHERE conv_id % 3 = 0"""
)
def summary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session changes from answers: blank ones and failures change nothing."""
    n = F.col("conv_id") % 3
    counted = tables.messages(spark, sf_dir).groupBy("session_id", "conv_id").agg(F.count("*").alias("c"))
    text = F.concat(F.lit("  of "), F.col("c").cast("string"), F.lit(" "))
    answered = counted.select("session_id", F.when(n == 1, "  ").otherwise(text).alias("answer"), F.when(n == 2, "failed").alias("error"))
    return hooks.summaries(answered, F.lit(1)).select("session_id", "current_summary")


@_query(
    f"""WITH {_DELTAS}, c AS (SELECT call, index, coalesce(max_by(id, seq) FILTER (WHERE id <> ''), '') AS id, count(*) AS n FROM d GROUP BY ALL)
SELECT call, id, 'result ' || n AS result FROM c"""
)
def calls_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results side by side, by position."""
    per = tables.deltas(spark, sf_dir).groupBy("call", "index").agg(F.count("*").alias("n"))
    found = fragments.calls(tables.deltas(spark, sf_dir)).join(per, ["call", "index"])
    both = found.groupBy("call").agg(F.array_sort(F.collect_list(F.struct("index", "id", F.concat(F.lit("result "), F.col("n").cast("string")).alias("result")))).alias("x"))
    zipped = hooks.with_results(F.transform("x", lambda e: e["id"]), F.transform("x", lambda e: e["result"]))
    return both.select("call", F.explode(zipped).alias("z")).select("call", F.col("z.call").alias("id"), "z.result")


def _tools() -> fragments.Registry:
    tools = fragments.Registry()
    tools.register("click", "Says what was clicked.", {}, lambda args: "clicked " + args["k"])
    tools.register("view", "Needs an argument that no event has.", {}, lambda args: args["missing"])
    return tools


@_query(
    """SELECT event_id AS call, CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'click' THEN 'clicked ' || json_extract_string(props, '$.k')
       WHEN 'view' THEN '[Tool Execution Error]: KeyError: ''missing''' ELSE '[Tool Error] Unknown tool: ' || event_type END AS output FROM events"""
)
def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a tool call that is run; a failure is the call's result."""
    called = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("call"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"), F.col("props").alias("arguments"))
    return fragments.run_tools(called, _tools().functions())


@_query(
    f"""WITH {MESSAGES}, q AS (
  SELECT session_id, CASE WHEN session_id::BIGINT % 5 = 1 THEN '' WHEN session_id::BIGINT % 5 = 2 THEN 'zzzz' ELSE '{KEYWORD}' END AS keyword, session_id::BIGINT % 5 = 3 AS late
  FROM (SELECT DISTINCT session_id FROM messages)
), hit AS (
  SELECT q.session_id, '[' || role || '] (' || {iso("created_at")} || '): ' || coalesce(content, '') AS line, row_number() OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS r
  FROM q JOIN messages m USING (session_id)
  WHERE keyword = '{KEYWORD}' AND NOT late AND list_has_any({_TOKENS.format("lower(content)")}, ['and', 'with', 'this']) QUALIFY r <= 10
), j AS (SELECT session_id, string_agg(line, chr(10) ORDER BY r) AS t FROM hit GROUP BY 1)
SELECT session_id AS request_id, CASE WHEN keyword = '' THEN '[Tool Error] Missing required argument: keyword.'
  WHEN t IS NULL THEN '[Tool Result] No messages found for keyword: ''' || keyword || '''.' WHEN length(t) > 4000 THEN t[:4000] || chr(10) || '...[truncated]' ELSE t END AS output
FROM q LEFT JOIN j USING (session_id)"""
)
def history_tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history tool for one request a session: a missing keyword, one that
    nothing holds, times after the session, and plain ones, by turns."""
    messages = tables.messages(spark, sf_dir)
    n = F.col("session_id").cast("long") % 5
    # No fixed time comes after every session: their times grow with the table.
    after = T.iso(F.col("last") + F.expr("INTERVAL '1' MINUTE"))
    requests = messages.groupBy("session_id").agg(F.max("created_at").alias("last")).select(
        F.col("session_id").alias("request_id"), "session_id", F.when(n == 1, " ").when(n == 2, "zzzz").otherwise(KEYWORD).alias("keyword"),
        F.when(n == 3, after).when(n == 4, "not a time").alias("start_time"), F.lit(None).cast("string").alias("end_time"),
    )
    return search.history_tool(messages, requests)


@_query(f"""WITH {MESSAGES} SELECT session_id, ordinal, role FROM messages""")
def appended_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bulk appends to a message store, read back."""
    rows, path = tables.messages(spark, sf_dir).select("session_id", "ordinal", "role"), state.scratch(spark)
    for part in (rows.where("ordinal % 2 = 0"), rows.where("ordinal % 2 <> 0")):
        mutations.append(part, path)
    return spark.read.schema(rows.schema).parquet(path)


@_query(f"""WITH {SESSIONS} SELECT s.user_id, m.role, m.content FROM messages m JOIN sessions s USING (session_id)""")
def memory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a memory store takes in."""
    return hooks.ingested(tables.messages(spark, sf_dir), tables.sessions(spark, sf_dir))


@_query("""SELECT CAST(label AS VARCHAR) AS user_id, CAST(vec_id AS VARCHAR) AS id, 'memory ' || vec_id AS memory, 0 AS n_metadata FROM embeddings""")
def memory_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's store as public fields; no metadata is an empty map."""
    return memory.listed(tables.memories(spark, sf_dir)).select("user_id", "id", "memory", F.size("metadata").alias("n_metadata"))


@_query(
    """SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 900 END AS VARCHAR) AS context_tokens, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'gpt-4o-mini' END AS default_model FROM customer"""
)
def settings_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as map columns laid over each other, the last one winning."""
    n = F.col("c_custkey")
    base = F.create_map(F.lit("context_tokens"), F.lit("900"), F.lit("default_model"), F.lit("gpt-4o-mini"))
    first = F.when(n % 2 == 0, F.create_map(F.lit("context_tokens"), F.col("c_nationkey").cast("string")))
    second = F.when(n % 3 == 0, F.create_map(F.lit("default_model"), F.col("c_mktsegment")))
    laid = tables.read(spark, sf_dir, "customer").select(n, overlaid(base, first, second).alias("s"))
    return laid.select("c_custkey", F.element_at("s", "context_tokens").alias("context_tokens"), F.element_at("s", "default_model").alias("default_model"))


@_query(
    f"""WITH {SESSIONS}, o AS (SELECT session_id, user_id, {_MODEL_OF} AS model FROM sessions)
SELECT session_id, ordinal, 'cold' AS sink, 1 AS n FROM messages UNION ALL SELECT session_id, ordinal, 'hot', 1 FROM (SELECT * FROM messages QUALIFY {_LAST_FIVE})
UNION ALL SELECT session_id, -1, 'usage', CAST(sum(token_count) AS INTEGER) FROM messages GROUP BY 1"""
)
def stream_post_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post-turn sink over the message stream, its folders read back."""
    root, stream = state.scratch(spark), state.message_stream(spark, sf_dir)
    # The sink orders by time; the stream has the ordinal for it.
    timed = stream.withColumn("created_at", F.expr("timestamp_seconds(conv_id * 3600 + ordinal * 60)"))
    usage = lambda rows: rows.groupBy("session_id").agg(F.sum("token_count").alias("n"))
    query = timed.writeStream.foreachBatch(state.post_turn(f"{root}/rows", usage, 5)).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    one = F.lit(1).alias("n")
    cold = spark.read.parquet(f"{root}/rows/cold").select("session_id", "ordinal", F.lit("cold").alias("sink"), one)
    hot = history.last_n(spark.read.parquet(f"{root}/rows/hot"), 5).select("session_id", "ordinal", F.lit("hot").alias("sink"), one)
    used = spark.read.schema("session_id string, n long").json(f"{root}/rows/usage").groupBy("session_id").agg(F.sum("n").cast("int").alias("n"))
    return cold.unionByName(hot).unionByName(used.select("session_id", F.lit(-1).cast("long").alias("ordinal"), F.lit("usage").alias("sink"), "n"))


@_query(f"""WITH {MESSAGES} SELECT session_id, ordinal FROM messages WHERE created_at BETWEEN TIMESTAMP '2024-01-01 05:00:00' AND TIMESTAMP '2024-01-02 20:03:00'""")
def messages_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages in a range of times, both ends included."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return history.within(tables.messages(spark, sf_dir), at("2024-01-01 05:00:00"), at("2024-01-02 20:03:00")).select("session_id", "ordinal")


@_query(f"""WITH {MESSAGES} SELECT ordinal, role, content FROM messages WHERE session_id = '7' AND created_at > TIMESTAMP '2024-01-01 07:01:00' ORDER BY created_at, ordinal LIMIT 50""")
def one_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point read: one session's messages after a time."""
    found = history.of_session(tables.messages(spark, sf_dir), "7", F.lit("2024-01-01 07:01:00").cast("timestamp_ntz"))
    return found.select("ordinal", "role", "content")


@_query("""SELECT CAST(vec_id AS VARCHAR) AS id, 'memory ' || vec_id AS memory FROM embeddings WHERE label = 3""")
def memories_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.listed(tables.memories(spark, sf_dir)).where("user_id = '3'").select("id", "memory")


def _words(text: str) -> int:
    """A stand-in for a tokenizer, which fails on some texts."""
    if len(text) % 7 == 0:
        raise ValueError("no tokens")
    return text.count(" ") + 1


_SPACED = "length(text) - length(replace(text, ' ', '')) + 1"


@_query(
    f"""SELECT conv_id, turn, CASE WHEN text IS NULL OR text = '' THEN 0 WHEN length(text) % 7 = 0 THEN length(text) // 4 ELSE {_SPACED} END AS tokens,
       CASE WHEN text IS NULL OR text = '' THEN 0 WHEN length(text) % 7 = 0 THEN length(text) ELSE {_SPACED} END AS characters_on_failure,
       CASE WHEN turn % 2 = 0 THEN 5 ELSE coalesce(length(text) // 4, 0) END AS filled FROM conversations"""
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer in Arrow batches, two ways to go on where it fails, and
    counts filled in where none is set."""
    short, full = T.counted_tokens(_words), T.counted_tokens(_words, len)
    return tables.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", short(F.col("text")).alias("tokens"), full(F.col("text")).alias("characters_on_failure"),
        T.filled_tokens(F.when(F.col("turn") % 2 == 0, F.lit(5).cast("long")), F.col("text")).alias("filled"),
    )


@_query(f"""WITH {MESSAGES} SELECT session_id, ordinal, role, content, token_count, {iso("created_at")} AS created_at, 'ä' AS note FROM messages""")
def hot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot rows as JSON, all columns but the id, read back by field."""
    rows = tables.messages(spark, sf_dir).select(F.lit("x").alias("id"), "session_id", "ordinal", "role", "content", "token_count", T.iso(F.col("created_at")).alias("created_at"), F.lit("ä").alias("note"))
    kept = [c for c in rows.columns if c != "id"]
    made = rows.select(F.to_json(F.struct(*kept)).alias("row"))
    return made.select(F.from_json("row", rows.select(*kept).schema).alias("r")).select("r.*")


@_query()
def segmented_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tokens of every document with its spaces taken out, by the words
    of all documents: a text as a script without spaces would have it."""
    docs = tables.read(spark, sf_dir, "documents")
    found = segmentation.segmented(docs, F.replace("text", F.lit(" "), F.lit("")), segmentation.learn(docs, "text"))
    return found.select("doc_id", F.size(F.split("search_tokens", " ")).alias("n_tokens"), "search_tokens")


@_query()
def model_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every message by the vocabulary of its session's model."""
    owners = _models(spark, sf_dir).select("session_id", "model")
    said = tables.messages(spark, sf_dir).join(owners, "session_id").withColumn("encoding", bytepairs.encoding_of(F.col("model")))
    return bytepairs.counted(said, F.col("content"), F.col("encoding")).select("session_id", "ordinal", "model", "encoding", "tokens")


@_query(
    f"""WITH {MESSAGES}, hit AS (
  SELECT session_id, ordinal, created_at, CAST(len(list_intersect({_TERMS}, {_TOKENS.format("lower(content)")})) AS INTEGER) AS matched
  FROM messages WHERE list_has_any({_TOKENS.format("lower(content)")}, {_TERMS}))
SELECT session_id, ordinal, matched, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS INTEGER) AS rank
FROM hit QUALIFY rank <= 10"""
)
def indexed_message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``message_search`` through a stored index, which two appends fill."""
    path, rows = f"{state.scratch(spark)}/index", tables.messages(spark, sf_dir)
    for half in (0, 1):
        index.append(rows.where(F.col("ordinal") % 2 == half), path)
    found = index.search(spark, path, KEYWORD)
    return found.select(F.col("owner").alias("session_id"), "ordinal", "matched", "rank")


@_query(
    f"""SELECT doc_id, CAST(len(list_intersect({_TERMS}, {_TOKENS.format("lower(text)")})) AS INTEGER) AS matched
FROM documents WHERE list_has_any({_TOKENS.format("lower(text)")}, {_TERMS})"""
)
def indexed_document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_search`` through a stored index."""
    path = f"{state.scratch(spark)}/index"
    rows = tables.read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.lit(None).cast("timestamp_ntz").alias("created_at"), "text")
    index.append(rows, path, "doc_id", "text", single=True)
    return index.documents(spark, path, KEYWORD).select(F.col("owner").cast("long").alias("doc_id"), "matched")


@_query(
    f"""WITH {MESSAGES}, r AS (
  SELECT session_id, ordinal, role, row_number() OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS r FROM messages WHERE role IN ('user', 'assistant')
)
SELECT session_id, ordinal, role, CAST(r - 2 AS INTEGER) AS rank FROM r WHERE r BETWEEN 3 AND 4"""
)
def history_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of two of each session's dialogue, from the last row of
    the first."""
    rows = history.dialogue(tables.messages(spark, sf_dir)).select("session_id", "created_at", "ordinal", "role")
    first = rows.limit(0).select("session_id", *history.IN_TIME)
    page = history.seek(rows, first, "session_id", history.IN_TIME, 2)
    last = page.groupBy("session_id").agg(F.max_by(F.struct(*history.IN_TIME), "rank").alias("l")).select("session_id", "l.*")
    return history.seek(rows, last, "session_id", history.IN_TIME, 2).select("session_id", "ordinal", "role", "rank")
