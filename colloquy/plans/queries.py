"""Queries over whole tables, each with the SQL that an oracle can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames
from ..functions import text as T
from ..operators import access, context, fragments, history, memory, metering, mutations, prompts, search
from ..settings import SETTINGS
from ..sources import tables
from ..streaming import state
from .views import MESSAGES, SESSIONS, WINDOWED, iso

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Model ids dealt out to sessions, as the tables name none.
MODELS = ("gpt-4o-mini", "gpt-4o", "deepseek-v3", "glm-4", "custom-model-x")
KEYWORD = "and with this"


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from . import recalls, rounds, turns  # noqa: F401  register their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


@_query(
    f"""WITH {WINDOWED}
SELECT session_id, ordinal, role, token_count, tokens_from_here, bucket, needs_compression FROM windowed"""
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which messages stay in each session's token budget."""
    found = context.window(tables.messages(spark, sf_dir))
    return found.select("session_id", "ordinal", "role", "token_count", "tokens_from_here", "bucket", "needs_compression")


@_query(
    f"""WITH {MESSAGES}
SELECT session_id, CAST(sum(token_count) AS BIGINT) AS total_tokens, sum(token_count) >= 720 AS needs_compression FROM messages GROUP BY 1"""
)
def needs_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.over_budget(tables.messages(spark, sf_dir))


@_query(
    f"""WITH {MESSAGES}
SELECT session_id, ordinal, role, content, {iso("created_at")} AS created_at,
       CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS INTEGER) AS rank
FROM messages QUALIFY rank <= 50"""
)
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 messages of every session."""
    found = history.first_n(tables.messages(spark, sf_dir), 50)
    return found.select("session_id", "ordinal", "role", "content", T.iso(F.col("created_at")).alias("created_at"), "rank")


@_query(
    f"""WITH {SESSIONS}
SELECT m.session_id, m.ordinal, m.role FROM messages m JOIN sessions s USING (session_id)
WHERE coalesce(m.created_at > s.summary_updated_at, true)"""
)
def history_after_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.after_summary(tables.messages(spark, sf_dir), tables.sessions(spark, sf_dir))
    return found.select("session_id", "ordinal", "role")


@_query(
    f"""WITH {MESSAGES}, d AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS r, count(*) OVER (PARTITION BY session_id) AS total
  FROM messages WHERE role IN ('user', 'assistant')
), t AS (SELECT DISTINCT session_id, total FROM d)
SELECT t.session_id, t.total, d.ordinal, d.session_id || '-' || d.ordinal AS id, d.role, d.content, CAST(NULL AS VARCHAR) AS tool_calls,
       {iso("d.created_at")} AS created_at, CAST(2 AS BIGINT) AS page, CAST(3 AS BIGINT) AS size, CAST(ceil(t.total / 3.0) AS BIGINT) AS total_page
FROM t LEFT JOIN d ON d.session_id = t.session_id AND d.r BETWEEN 4 AND 6"""
)
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of three of each session's dialogue, with totals."""
    rows = history.dialogue(tables.messages(spark, sf_dir)).select("session_id", "created_at", "ordinal", "role", "content")
    found = history.paged(rows, "session_id", [F.col("created_at"), F.col("ordinal")], 2, 3)
    made = F.concat_ws("-", F.when(F.col("ordinal").isNotNull(), F.col("session_id")), F.col("ordinal").cast("string"))
    return found.select(
        "session_id", "total", "ordinal", F.nullif(made, F.lit("")).alias("id"), "role", "content", F.lit(None).cast("string").alias("tool_calls"),
        T.iso(F.col("created_at")).alias("created_at"), "page", "size", "total_page",
    )


@_query(
    f"""WITH {SESSIONS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, session_id) AS r, count(*) OVER (PARTITION BY user_id) AS total FROM sessions
)
SELECT user_id, total, session_id, title, {iso("created_at")} AS created_at, {iso("updated_at")} AS updated_at,
       CAST(1 AS BIGINT) AS page, CAST(20 AS BIGINT) AS size, CAST(ceil(total / 20.0) AS BIGINT) AS total_page
FROM r WHERE r <= 20"""
)
def session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of every user's sessions, as the public fields."""
    rows = tables.sessions(spark, sf_dir).select("user_id", "session_id", "title", "created_at", "updated_at")
    found = history.paged(rows, "user_id", [F.desc("updated_at"), F.col("session_id")], 1, SETTINGS.page_size)
    return found.select(
        "user_id", "total", "session_id", "title", T.iso(F.col("created_at")).alias("created_at"), T.iso(F.col("updated_at")).alias("updated_at"), "page", "size", "total_page"
    )


@_query(
    f"""WITH {SESSIONS}
SELECT m.session_id, m.ordinal, m.role FROM messages m SEMI JOIN (SELECT session_id FROM sessions WHERE user_id = CAST(conv_id % 7 AS VARCHAR)) g USING (session_id)"""
)
def owned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions asked for by a user, and only those that are the user's own."""
    sessions = tables.sessions(spark, sf_dir)
    asked = sessions.select("session_id", (F.col("conv_id") % 7).cast("string").alias("user_id"))
    return history.owned(tables.messages(spark, sf_dir), sessions, asked).select("session_id", "ordinal", "role")


_TERMS = "['and', 'with', 'this']"
_TOKENS = "list_filter(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 1)"


@_query(
    f"""WITH {MESSAGES}, hit AS (SELECT * FROM messages WHERE list_has_any({_TOKENS.format("lower(content)")}, {_TERMS}))
SELECT session_id, ordinal, role, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS INTEGER) AS rank
FROM hit QUALIFY rank <= 10"""
)
def message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's earliest messages with any of the keyword's words."""
    return search.search_messages(tables.messages(spark, sf_dir), KEYWORD).select("session_id", "ordinal", "role", "rank")


@_query(
    f"""SELECT doc_id, CAST(len(list_intersect({_TERMS}, {_TOKENS.format("lower(text)")})) AS INTEGER) AS matched
FROM documents WHERE list_has_any({_TOKENS.format("lower(text)")}, {_TERMS})"""
)
def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.read(spark, sf_dir, "documents").where(search.matches(F.col("text"), KEYWORD))
    return found.select("doc_id", search.matched_terms(F.col("text"), KEYWORD).alias("matched"))


@_query(
    f"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string({_TOKENS.format("text")}, ' ') END AS search_tokens FROM documents"""
)
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", T.search_tokens(F.col("text")).alias("search_tokens"))


@_query(
    f"""WITH {MESSAGES}, hit AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, ordinal) AS r
  FROM messages WHERE list_has_any({_TOKENS.format("lower(content)")}, {_TERMS}) QUALIFY r <= 10
), j AS (
  SELECT session_id, string_agg('[' || role || '] (' || {iso("created_at")} || '): ' || coalesce(content, ''), chr(10) ORDER BY r) AS t FROM hit GROUP BY 1
)
SELECT session_id, CASE WHEN length(t) > 4000 THEN t[:4000] || chr(10) || '...[truncated]' ELSE t END AS result FROM j"""
)
def search_result_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the history tool answers for the keyword, for every session."""
    return search.rendered(search.search_messages(tables.messages(spark, sf_dir), KEYWORD))


@_query(
    """SELECT doc_id, CASE WHEN length(text) > 4000 THEN text[:4000] || chr(10) || '...[truncated]' ELSE text END AS shown FROM documents"""
)
def truncated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", T.truncated(F.col("text")).alias("shown"))


_HOT_SQL = """SELECT session_id, ordinal, role, content, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, ordinal DESC) AS INTEGER) AS age
FROM messages {} QUALIFY age <= 5"""


@_query(f"WITH {MESSAGES} {_HOT_SQL.format('')}")
def hot_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped recent list; five, as no conversation reaches fifty."""
    return context.hot(tables.messages(spark, sf_dir), 5).select("session_id", "ordinal", "role", "content", "age")


@_query(
    f"""WITH {SESSIONS}, hot AS ({_HOT_SQL.format("WHERE conv_id % 2 = 0")}), cold AS (
  SELECT m.*, row_number() OVER (PARTITION BY session_id ORDER BY m.created_at DESC, ordinal DESC) AS age
  FROM messages m JOIN sessions s USING (session_id)
  WHERE m.conv_id % 2 <> 0 AND coalesce(m.created_at > s.summary_updated_at, true) QUALIFY age <= 20
)
SELECT session_id, ordinal, role, content, 'hot' AS origin FROM hot UNION ALL SELECT session_id, ordinal, role, content, 'cold' FROM cold"""
)
def hot_or_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = tables.messages(spark, sf_dir)
    hot = context.hot(messages.where("conv_id % 2 = 0"), 5)
    return context.hot_or_cold(messages, tables.sessions(spark, sf_dir), hot)


_TRANSCRIPT = "string_agg(role || ': ' || coalesce(content, ''), chr(10) ORDER BY created_at, ordinal)"


@_query(
    f"""WITH {WINDOWED}, t AS (SELECT session_id, {_TRANSCRIPT} AS t FROM windowed WHERE bucket = 'compress' GROUP BY 1)
SELECT session_id, concat_ws(chr(10) || chr(10),
  CASE WHEN current_summary <> '' THEN '{prompts.EARLIER_HEADING}' || chr(10) || current_summary END,
  '{prompts.LATER_HEADING}' || chr(10) || t, '{prompts.SUMMARISE}') AS prompt
FROM t LEFT JOIN sessions USING (session_id)"""
)
def summary_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summariser would read for each session."""
    return prompts.summary_input(context.window(tables.messages(spark, sf_dir)), tables.sessions(spark, sf_dir))


_RECALL = """recalled AS (
  SELECT label, vec_id, rank FROM (
    SELECT label, vec_id, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
      SELECT e.label, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q))
  WHERE rank <= 5 AND score >= {}
)"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = tables.memories(spark, sf_dir).where("id = 0").select("embedding").first()
    return list(row[0]) if row else []


@_query(f"""WITH {_RECALL.format("0.0")} SELECT CAST(label AS VARCHAR) AS user_id, vec_id AS id, rank FROM recalled""")
def memory_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five by score, then the threshold, for each user."""
    found = memory.recall(tables.memories(spark, sf_dir), _query_vector(spark, sf_dir), SETTINGS.rerank_limit, 0.0)
    return found.select("user_id", "id", "rank")


@_query(
    f"""WITH {WINDOWED}, {_RECALL.format("0.0")}, facts AS (
  SELECT CAST(label AS VARCHAR) AS user_id, string_agg('- memory ' || vec_id, chr(10) ORDER BY rank) AS facts FROM recalled GROUP BY 1
), head AS (SELECT * FROM sessions LEFT JOIN facts USING (user_id))
SELECT session_id, 0 AS part, CAST(0 AS BIGINT) AS ordinal, 'system' AS role,
       '{prompts.ASSISTANT}' || chr(10) || coalesce(chr(10) || '{prompts.FACTS_HEADING}' || chr(10) || facts || chr(10), '') AS content FROM head
UNION ALL SELECT session_id, 1, 0, 'system', '{prompts.SUMMARY_HEADING}' || chr(10) || current_summary FROM head WHERE current_summary IS NOT NULL
UNION ALL SELECT session_id, 2, ordinal, role, content FROM windowed WHERE bucket = 'keep'
UNION ALL SELECT session_id, 3, 0, 'user', 'What next in ' || session_id || '?' FROM sessions"""
)
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole prompt of each session, a row for each message."""
    sessions = tables.sessions(spark, sf_dir)
    facts = memory.facts(memory.recall(tables.memories(spark, sf_dir), _query_vector(spark, sf_dir), SETTINGS.rerank_limit, 0.0))
    query = F.concat(F.lit("What next in "), F.col("session_id"), F.lit("?"))
    return prompts.assemble(context.window(tables.messages(spark, sf_dir)), sessions, facts, query)


_MODEL_OF = "CASE conv_id % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END"
_KIND_OF = f"CASE WHEN model IN {SETTINGS.standard_models} THEN 1 WHEN model IN {SETTINGS.advanced_models} THEN 2 ELSE 3 END"


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sessions(spark, sf_dir).select("session_id", "user_id", F.expr(_MODEL_OF).alias("model"))


@_query(
    f"""WITH {SESSIONS}, o AS (SELECT session_id, user_id, {_MODEL_OF} AS model FROM sessions), p AS (
  SELECT user_id, model, sum(token_count) AS n FROM messages JOIN o USING (session_id) GROUP BY ALL HAVING sum(token_count) <> 0
)
SELECT user_id, model, CAST(n AS BIGINT) AS usage_tokens, {_KIND_OF} AS model_type,
       CAST(n * CASE {_KIND_OF} WHEN 2 THEN 10 ELSE 1 END AS BIGINT) AS weighted_tokens FROM p"""
)
def usage_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = _models(spark, sf_dir)
    dimension = owners.select("model").distinct().where(F.col("model") != MODELS[-1]).withColumn("model_type", T.model_type(F.col("model")))
    return metering.usage(tables.messages(spark, sf_dir), owners, dimension).select("user_id", "model", "usage_tokens", "model_type", "weighted_tokens")


@_query(
    f"""WITH {SESSIONS}, o AS (SELECT session_id, user_id, {_MODEL_OF} AS model FROM sessions), p AS (
  SELECT user_id, model, sum(token_count) AS n FROM messages JOIN o USING (session_id) GROUP BY ALL HAVING sum(token_count) <> 0
)
SELECT user_id AS key, user_id AS "userId", CASE WHEN user_id <> '3' THEN 'g' || user_id END AS "groupId", CAST(n AS BIGINT) AS "usageTokens",
       'trace-' || user_id AS "traceId", {_KIND_OF} AS "modelType", '2024-02-01T00:00:00' AS "requestTime" FROM p"""
)
def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage as JSON events, read back by field."""
    group = F.when(F.col("user_id") != "3", F.concat(F.lit("g"), F.col("user_id")))
    trace = F.concat(F.lit("trace-"), F.col("user_id"))
    events = metering.usage_events(usage_by_user(spark, sf_dir), F.lit("2024-02-01 00:00:00").cast("timestamp"), group, trace)
    fields = F.from_json("value", "userId string, groupId string, usageTokens long, traceId string, modelType int, requestTime string")
    return events.select("key", fields.alias("v")).select("key", "v.*")


@_query(
    f"""WITH {SESSIONS}, o AS (SELECT {_MODEL_OF} AS model, count(*) AS n_sessions FROM sessions GROUP BY 1)
SELECT model, n_sessions, {_KIND_OF} AS type, CASE {_KIND_OF} WHEN 2 THEN 10 ELSE 1 END AS ratio, model = 'gpt-4o-mini' AS is_default,
       CASE model WHEN 'gpt-4o-mini' THEN 'GPT-4o Mini' WHEN 'gpt-4o' THEN 'GPT-4o' WHEN 'deepseek-v3' THEN 'DeepSeek V3' WHEN 'glm-4' THEN 'GLM 4' ELSE 'Custom Model X' END AS name
FROM o"""
)
def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that sessions use, with their computed fields."""
    used = _models(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n_sessions"))
    return metering.catalogue(used, SETTINGS.default_model).select("model", "n_sessions", "type", "ratio", "is_default", "name")


@_query(
    f"""WITH {SESSIONS}, o AS (SELECT DISTINCT {_MODEL_OF} AS model FROM sessions)
SELECT {_KIND_OF} AS type, string_agg(model, ',' ORDER BY model) AS models FROM o GROUP BY 1"""
)
def model_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = metering.catalogue(_models(spark, sf_dir).select("model").distinct(), SETTINGS.default_model)
    return metering.by_type(used).select("type", F.array_join("models", ",").alias("models"))


@_query(
    f"""WITH s AS (
  SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
    SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 24 HOUR, true) AS gap FROM events)
)
SELECT user_id, {iso("min(ts)")} AS start, {iso("max(ts) + INTERVAL 24 HOUR")} AS end, count(*) AS writes FROM s GROUP BY user_id, g"""
)
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each user's hot list would have lived."""
    found = context.inactivity(tables.read(spark, sf_dir, "events"), "user_id", "ts")
    return found.select("user_id", T.iso(F.col("start")).alias("start"), T.iso(F.col("end")).alias("end"), "writes")


@_query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(len(json_keys(props)) AS INTEGER) AS n_arguments FROM events""")
def payload_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.read(spark, sf_dir, "events").select("event_id", T.json_arguments(F.col("props")).alias("args"))
    return found.select("event_id", F.try_element_at("args", F.lit("k")).alias("k"), F.size("args").alias("n_arguments"))


_DELTAS = """d AS (
  SELECT user_id AS call, epoch_us(ts) AS seq, CAST(event_id % 2 AS INTEGER) AS index, event_id,
         CASE WHEN event_id % 5 = 0 THEN 'call_' || event_id ELSE '' END AS id, CASE WHEN event_id % 7 = 0 THEN event_type END AS name,
         props AS arguments, CASE WHEN event_id % 3 = 0 THEN event_type || ' ' END AS content,
         CASE WHEN event_id % 11 = 0 THEN 'tool_calls' END AS finish_reason
  FROM events
)"""


@_query(
    f"""WITH {_DELTAS}
SELECT call, index, coalesce(max_by(id, seq) FILTER (WHERE id <> ''), '') AS id, coalesce(string_agg(name, '' ORDER BY seq, name), '') AS name,
       coalesce(string_agg(arguments, '' ORDER BY seq, arguments), '') AS arguments
FROM d GROUP BY call, index"""
)
def fragment_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls from interleaved fragments."""
    return fragments.calls(tables.deltas(spark, sf_dir))


@_query(
    f"""WITH {_DELTAS}
SELECT call, coalesce(string_agg(content, '' ORDER BY seq, content), '') AS content,
       coalesce(max_by(finish_reason, seq) FILTER (WHERE finish_reason IS NOT NULL), 'stop') AS finish_reason
FROM d GROUP BY call"""
)
def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.texts(tables.deltas(spark, sf_dir))


@_query(
    f"""WITH {_DELTAS}, c AS (
  SELECT call, index, coalesce(max_by(id, seq) FILTER (WHERE id <> ''), '') AS id, coalesce(string_agg(name, '' ORDER BY seq, name), '') AS name FROM d GROUP BY call, index
)
SELECT call, count(*) AS n_calls, string_agg(id, ',' ORDER BY id, name) AS ids, string_agg('function ' || name, ',' ORDER BY id, name) AS functions FROM c GROUP BY 1"""
)
def tool_call_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protocol's array of each call's tool calls, by id as a string."""
    found = fragments.call_arrays(fragments.calls(tables.deltas(spark, sf_dir)))
    ids = F.array_join(F.transform("tool_calls", lambda c: c["id"]), ",")
    functions = F.array_join(F.transform("tool_calls", lambda c: F.concat_ws(" ", c["type"], c["function"]["name"])), ",")
    return found.select("call", F.size("tool_calls").cast("long").alias("n_calls"), ids.alias("ids"), functions.alias("functions"))


@_query(
    """SELECT event_id, coalesce(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'ok ' || event_type END, '[Tool Error] Unknown tool: ' || event_type) AS output FROM events"""
)
def tool_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a call by name; unknown names are error texts."""
    called = tables.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"))
    registry = called.where(F.col("name").isin("click", "view", "purchase")).select("name").distinct().withColumn("output", F.concat(F.lit("ok "), F.col("name")))
    return fragments.dispatched(called, registry).select("event_id", "output")


@_query(
    f"""WITH {MESSAGES}
SELECT session_id, CAST(least(count(*) FILTER (WHERE role = 'assistant'), 2) AS BIGINT) AS steps, count(*) FILTER (WHERE role = 'assistant') > 2 AS exhausted
FROM messages GROUP BY 1"""
)
def tool_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant steps against a cap of two."""
    return fragments.rounds(tables.messages(spark, sf_dir), 2)


@_query(
    f"""WITH {MESSAGES}, f AS (
  SELECT session_id, ordinal, unnest(['text-start', 'text-delta', 'text-end']) AS type, content FROM messages WHERE role = 'assistant'
)
SELECT session_id, ordinal, type, 'txt_' || session_id || '_' || ordinal AS id, CASE WHEN type = 'text-delta' THEN content END AS delta FROM f"""
)
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text frames of every answer, read back by field."""
    said = tables.messages(spark, sf_dir).where("role = 'assistant'")
    name = F.concat(F.lit("txt_"), F.col("session_id"), F.lit("_"), F.col("ordinal").cast("string"))
    made = F.array(frames.frame("text-start", id=name), frames.frame("text-delta", id=name, delta=F.col("content")), frames.frame("text-end", id=name))
    body = F.regexp_extract("frame", r"(?s)^data: (.*)\n\n$", 1)
    fields = F.from_json(body, "type string, id string, delta string").alias("f")
    return said.select("session_id", "ordinal", F.explode(made).alias("frame")).select("session_id", "ordinal", fields).select("session_id", "ordinal", "f.*")


@_query(f"""WITH {MESSAGES} SELECT session_id, ordinal, role, content FROM messages""")
def wire_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's JSON message, read back by field."""
    found = fragments.wire(tables.messages(spark, sf_dir))
    return found.select("session_id", "ordinal", F.from_json("wire", "role string, content string").alias("w")).select("session_id", "ordinal", "w.*")


_BOUND = "CASE event_id % 3 WHEN 0 THEN {t} WHEN 1 THEN 'not a time' END"


@_query(
    """WITH e AS (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN 'not a time' END AS s,
         CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN 'not a time' END AS t FROM events
)
SELECT event_id, strftime(try_cast(s AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS start,
       CASE WHEN s IS NULL OR try_cast(s AS TIMESTAMP) IS NOT NULL THEN strftime(try_cast(t AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') END AS end FROM e"""
)
def time_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional time arguments: a bad start voids both, a bad end itself."""
    at = T.iso(F.col("ts"))
    asked = tables.read(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, at).when(F.col("event_id") % 3 == 1, "not a time").alias("s"),
        F.when(F.col("event_id") % 4 == 0, at).when(F.col("event_id") % 4 == 1, "not a time").alias("t"),
    )
    start, end = T.time_bounds(F.col("s"), F.col("t"))
    return asked.select("event_id", T.iso(start).alias("start"), T.iso(end).alias("end"))


@_query(
    """WITH r AS (
  SELECT c_custkey, c_custkey % 5 AS identity, c_custkey % 5 AS code, c_nationkey, c_custkey % 3 <> 0 AS member FROM customer
)
SELECT c_custkey, CASE identity WHEN 1 THEN 'STUDENT' WHEN 2 THEN 'TEACHER' WHEN 3 THEN 'ADMIN' ELSE '' END AS identity_name,
       CASE WHEN NOT member OR code > 2 THEN 'NOT_MEMBER' WHEN code = 0 THEN 'OWNER' WHEN code = 1 THEN 'ADMIN' ELSE 'MEMBER' END AS group_role,
       identity IN (1, 2) AND member AND code IN (0, 1) AS allowed FROM r"""
)
def access_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as callers with a JSON map of group roles."""
    asked = tables.read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_custkey").cast("string").alias("user_id"),
        (F.col("c_custkey") % 5).cast("int").alias("identity"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string")).otherwise("other").alias("group_id"),
        F.concat(F.lit('{"'), F.col("c_nationkey").cast("string"), F.lit('":'), (F.col("c_custkey") % 5).cast("string"), F.lit("}")).alias("role_json"),
    )
    return access.checked(asked, (1, 2), (0, 1)).select("c_custkey", "identity_name", "group_role", "allowed")


_CHANGED = """c AS (
  SELECT s.session_id, user_id, updated_at, CASE WHEN conv_id % 4 = 0 THEN 'Renamed ' || session_id ELSE title END AS title,
         conv_id % 6 = 0 AS is_pinned, CASE WHEN conv_id % 6 = 0 THEN updated_at END AS pinned_at, conv_id FROM sessions s
)"""


@_query(
    f"""WITH {SESSIONS}, {_CHANGED}, d AS (SELECT * FROM c WHERE conv_id % 9 <> 0 OR conv_id % 2 <> 0)
SELECT user_id, session_id, title, is_pinned,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY is_pinned DESC, pinned_at DESC NULLS LAST, updated_at DESC, session_id) AS INTEGER) AS place
FROM d"""
)
def session_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames, pins and owner-checked deletes, then the pinned order."""
    sessions = tables.sessions(spark, sf_dir)
    state_now = sessions.select("session_id", "user_id", "updated_at", "title", F.lit(False).alias("is_pinned"), F.lit(None).cast("timestamp_ntz").alias("pinned_at"), "conv_id")
    none = F.lit(None)
    renames = sessions.where("conv_id % 4 = 0").select(
        "session_id", F.lit(1).alias("changed_at"), F.lit("old name").alias("title"), none.cast("boolean").alias("is_pinned"), none.cast("timestamp_ntz").alias("pinned_at")
    )
    again = renames.withColumn("changed_at", F.lit(2)).withColumn("title", F.concat(F.lit("Renamed "), F.col("session_id")))
    pins = sessions.where("conv_id % 6 = 0").select(
        "session_id", F.lit(1).alias("changed_at"), none.cast("string").alias("title"), F.lit(True).alias("is_pinned"), F.col("updated_at").alias("pinned_at")
    )
    changed = mutations.updated(state_now, renames.unionByName(again).unionByName(pins))
    # A deletion by another user than the owner does nothing.
    gone = sessions.where("conv_id % 9 = 0").select("session_id", F.when(F.col("conv_id") % 2 == 0, F.col("user_id")).otherwise("someone else").alias("user_id"))
    return mutations.pinned_first(mutations.deleted(changed, gone)).select("user_id", "session_id", "title", "is_pinned", "place")


@_query(
    """SELECT CAST(label AS VARCHAR) AS user_id, count(*) AS n, min(vec_id) AS least FROM embeddings
WHERE NOT (vec_id % 3 = 0 AND vec_id % 2 = 0) AND label <> 7 GROUP BY 1"""
)
def memory_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single deletes, checked against the owner, and one user's whole store."""
    items = tables.memories(spark, sf_dir).select("id", "user_id", "memory")
    asked = items.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise("someone else").alias("user_id"))
    users = items.where("user_id = '7'").select("user_id").distinct()
    left = memory.without_users(memory.without(items, asked), users)
    return left.groupBy("user_id").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@_query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 500 ELSE 200 END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 50011 ELSE 40001 END AS code,
       CASE WHEN o_orderkey % 2 = 0 THEN 'generation failed' ELSE 'not found' END AS msg FROM orders"""
)
def error_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error codes with their status and envelope, a row for each order."""
    code = F.when(F.col("o_orderkey") % 2 == 0, 50011).otherwise(40001)
    text = F.when(F.col("o_orderkey") % 2 == 0, "generation failed").otherwise("not found")
    made = tables.read(spark, sf_dir, "orders").select("o_orderkey", T.http_status(code).alias("status"), T.envelope(code, text, F.lit(None).cast("string")).alias("e"))
    return made.select("o_orderkey", "status", "e.code", "e.msg")


@_query(
    """SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS place FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 20"""
)
def newest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of every user over the larger orders table."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= SETTINGS.page_size).select("o_custkey", "o_orderkey", "place")


@_query(
    f"""WITH {MESSAGES}, h AS ({_HOT_SQL.format("")})
SELECT session_id, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) AS ordinals, count(*) AS n FROM h GROUP BY 1"""
)
def stream_hot_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped lists as a stream leaves them; equal to the batch ones."""
    lists = mutations.latest(state.appended(state.hot_lists(state.message_stream(spark, sf_dir), 5, seconds=None)), "session_id", "version")
    held = F.from_json("messages", "array<struct<ordinal:long>>")
    return lists.select("session_id", held.alias("h")).select("session_id", F.array_join(F.transform("h", lambda m: m["ordinal"].cast("string")), ",").alias("ordinals"), F.size("h").cast("long").alias("n"))


@_query(f"""WITH {MESSAGES} SELECT session_id, CAST(sum(token_count) AS BIGINT) AS usage_tokens, count(*) AS n_messages FROM messages GROUP BY 1""")
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = state.updated(state.running_usage(state.message_stream(spark, sf_dir)), "session_id")
    return found.select("session_id", "usage_tokens", "n_messages")
