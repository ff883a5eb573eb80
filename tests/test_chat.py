"""Cases that the tables lack: nulls, malformed JSON, ties, exact budgets."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from colloquy.functions import frames
from colloquy.functions import text as T
from colloquy.operators import access, context, fragments, history, hooks, memory, metering, mutations, prompts, search
from colloquy.settings import SETTINGS, configured, merged
from colloquy.streaming import state

AT = dt.datetime(2024, 1, 1)


def messages(spark, rows):
    return spark.createDataFrame([(s, o, r, c, n, AT) for s, o, r, c, n in rows], "session_id string, ordinal long, role string, content string, token_count long, created_at timestamp_ntz")


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(values[n], str) or values[n] is None else 'long'}" for n in names))
    return row.select(column).first()[0]


def test_budgets_are_inclusive(spark):
    assert (SETTINGS.low_budget, SETTINGS.high_budget) == (450, 720)
    rows = messages(spark, [("a", 1, "user", "x", 270), ("a", 2, "user", "x", 450), ("b", 1, "user", "x", None), ("b", 2, "user", "x", 719)])
    got = {(r["session_id"], r["ordinal"]): (r["bucket"], r["needs_compression"]) for r in context.window(rows).collect()}
    assert got == {("a", 2): ("keep", True), ("a", 1): ("compress", True), ("b", 2): ("compress", False), ("b", 1): ("compress", False)}


def test_settings_last_source_wins():
    laid = merged({"context_tokens": 10, "unknown": 1}, {"context_tokens": 1000})
    assert laid.high_budget == 800 and laid.low_budget == 500


def test_history(spark):
    rows = messages(spark, [("a", o, r, None if o == 2 else "text", 1) for o, r in enumerate(["system", "user", "assistant", "tool", "user"])])
    assert [r["ordinal"] for r in history.of_session(rows, "a", limit=2).collect()] == [0, 1]
    assert history.of_session(rows, "a", after=AT).count() == 0
    assert history.within(rows, AT, AT).count() == 5 and history.within(rows).count() == 5
    assert {r["ordinal"] for r in history.dialogue(rows).collect()} == {1, 2, 4}
    assert [r["ordinal"] for r in history.last_n(rows, 2).orderBy("ordinal").collect()] == [3, 4]
    empty = history.paged(history.dialogue(rows), "session_id", [F.col("ordinal")], 9, 2).collect()
    assert [(r["total"], r["ordinal"], r["total_page"]) for r in empty] == [(3, None, 2)]
    with pytest.raises(ValueError):
        history.bounds(0, 20)
    with pytest.raises(ValueError):
        history.bounds(1, 101)
    assert one(spark, T.pages(F.col("t"), F.col("s")), t=5, s=0) == 0


def test_search(spark):
    rows = messages(spark, [("a", 1, "user", "Hello big world", 1), ("a", 2, "user", "WORLD x", 1), ("a", 3, "user", None, 1), ("b", 1, "user", "nothing", 1)])
    got = search.rendered(search.search_messages(rows, " world a "))
    assert [(r["session_id"], r["result"]) for r in got.collect()] == [("a", "[user] (2024-01-01T00:00:00): Hello big world\n[user] (2024-01-01T00:00:00): WORLD x")]
    assert search.search_messages(rows, "  ").count() == 0 and search.search_messages(rows, "world", session_id="b").count() == 0


def test_text(spark):
    assert one(spark, T.search_tokens(F.col("t")), t="a Bb b-cc 12 日本語 dd") == "Bb cc 12 日本語 dd"
    assert one(spark, T.search_tokens(F.col("t")), t=None) is None
    split = T.segmented(lambda t: [t[i : i + 2] for i in range(0, len(t), 2)])
    assert one(spark, split(F.col("t")), t="日本語") == "日本"
    count = T.counted_tokens(lambda t: 1 // (t != "bad") * len(t.split()))
    assert [one(spark, count(F.col("t")), t=t) for t in ("a b c", "", "bad")] == [3, 0, 0]
    assert one(spark, T.truncated(F.col("t"), 3), t="abcdef") == "abc\n...[truncated]" and one(spark, T.truncated(F.col("t"), 3), t="abc") == "abc"
    for text, want in (('{"a": 1}', {"a": "1"}), ("{bad", {}), ("", {}), (None, {})):
        assert one(spark, T.json_arguments(F.col("t")), t=text) == want
    names = {"gpt-4o-mini": "GPT-4o Mini", "deepseek-v3": "DeepSeek V3", "glm-4": "GLM 4", "other-MODEL": "Other Model", "gpt": "GPT"}
    assert {m: one(spark, T.model_name(F.col("t")), t=m) for m in names} == names
    assert [one(spark, T.prefixed(F.col("t")), t=m) for m in ("m", "x/m")] == ["openai/m", "x/m"]
    assert one(spark, T.defaulted(F.col("t"), "d"), t="") == "d" and one(spark, T.hot_key(F.col("t")), t="1") == "hot:1"
    assert [one(spark, T.http_status(F.col("t")), t=c) for c in (49999, 50000)] == [200, 500]
    assert one(spark, T.filled_tokens(F.col("n"), F.col("t")), n=7, t=None) == 7 and one(spark, T.tool_error(F.lit("E"), F.col("t")), t="m") == "[Tool Execution Error]: E: m"
    assert one(spark, T.role_map(F.col("t")), t='{"g": 2}') == {"g": 2} and one(spark, T.role_map(F.col("t")), t="{no") is None


def test_fragments(spark):
    schema = "call string, seq long, index int, id string, name string, arguments string, content string, finish_reason string"
    rows = [
        ("c", 1, 0, "z9", "find", '{"a"', "He", None), ("c", 2, 1, "a1", "look", "{bad", None, None), ("c", 3, 0, "", None, ": 1}", "llo", None),
        ("c", 4, 1, None, None, None, None, "tool_calls"), ("d", 1, 0, None, None, None, None, None),
    ]
    deltas = spark.createDataFrame(rows, schema)
    texts = {r["call"]: (r["content"], r["finish_reason"]) for r in fragments.texts(deltas).collect()}
    assert texts == {"c": ("Hello", "tool_calls"), "d": ("", "stop")}
    calls = fragments.calls(deltas.where("call = 'c'"))
    array = fragments.call_arrays(calls).first()["tool_calls"]
    assert [(c["id"], c["type"], c["function"]["name"], json.loads(c["function"]["arguments"])) for c in array] == [("a1", "function", "look", {}), ("z9", "function", "find", {"a": "1"})]
    registry = fragments.Registry()
    registry.register("find", "finds", {}, lambda args: f"found {args['a']}")
    registry.register("find", "finds again", {}, lambda args: f"seen {args['a']}")
    assert len(registry) == 1 and registry.schemas()[0]["function"]["description"] == "finds again"
    with pytest.raises(KeyError):
        registry.get("none")
    found = {r["id"]: r["output"] for r in fragments.run_tools(calls, registry.functions()).collect()}
    assert found == {"z9": "seen 1", "a1": "[Tool Error] Unknown tool: look"}
    failing = {r["id"]: r["output"] for r in fragments.run_tools(calls, {"find": lambda a: 1 / 0, "look": lambda a: "ok"}).collect()}
    assert failing == {"z9": "[Tool Execution Error]: ZeroDivisionError: division by zero", "a1": "ok"}
    left = spark.createDataFrame([([1, 2, 3], 1), ([1], 1)], "a array<int>, n int").select(fragments.appended(F.col("a"), F.col("n"))).collect()
    assert [r[0] for r in left] == [[2, 3], []]
    wire = fragments.wire(messages(spark, [("a", 1, "user", None, 1)]).withColumn("name", F.lit(None).cast("string"))).first()["wire"]
    assert json.loads(wire) == {"role": "user", "content": ""}
    empties = messages(spark, [("a", 1, "user", "x", 1)]).selectExpr("*", "'' AS name", "'' AS tool_call_id", "cast(array() as array<struct<id:string>>) AS tool_calls")
    assert json.loads(fragments.wire(empties).first()["wire"]) == {"role": "user", "content": "x"}


def test_frames(spark):
    text = one(spark, frames.frame("text-delta", id=F.lit("t"), delta=F.col("x")), x='é "q"\n')
    assert text.startswith("data: ") and text.endswith("\n\n") and json.loads(text[6:]) == {"type": "text-delta", "id": "t", "delta": 'é "q"\n'}
    for kind, fields in frames.FIELDS.items():
        made = one(spark, frames.frame(kind, **{f: F.col("x") for f in fields}), x="v")
        assert json.loads(made[6:]) == {"type": kind} | dict.fromkeys(fields, "v")
    assert json.loads(one(spark, frames.data_frame("weather", F.struct(F.col("x").alias("place"))), x="v")[6:]) == {"type": "data-weather", "data": {"place": "v"}}
    assert one(spark, frames.done(), x="v") == "data: [DONE]\n\n"
    with pytest.raises(ValueError):
        frames.frame("finish", id=F.lit(1))


def test_prompts(spark):
    kind = StructType([StructField("s", ArrayType(StructType([StructField("key", StringType()), StructField("disabled", BooleanType()), StructField("value", StringType())])))])
    states = [[("selected_text", True, "no"), ("other", False, "x"), ("selected_text", None, "yes")], [("selected_text", True, "no")], []]
    got = spark.createDataFrame([(s,) for s in states], kind).select(prompts.first_selection(F.col("s"))).collect()
    assert [r[0] for r in got] == ["yes", None, None]
    assert one(spark, prompts.selected_text(F.col("q"), F.col("t")), q="why?", t=None) == "why?"
    assert "<selected_text>\nthis\n</selected_text>" in one(spark, prompts.selected_text(F.col("q"), F.col("t")), q="why?", t="this")
    text = prompts.transcript(messages(spark, [("a", 2, "user", None, 1), ("a", 1, "user", "first", 1)])).first()["transcript"]
    assert text == "user: first\nuser: "


def test_access(spark):
    rows = [("u", 1, "g", '{"g": 0}'), ("u", 1, "g", '{"g": 7}'), ("u", 1, "g", "{bad"), ("u", 9, "x", '{"g": 1}'), (None, 1, "g", '{"g": 1}'), ("u", None, "g", None)]
    got = access.checked(spark.createDataFrame(rows, "user_id string, identity int, group_id string, role_json string"), (1, 2), (0, 1)).collect()
    assert [(r["identity_name"], r["group_role"], bool(r["allowed"])) for r in got] == [
        ("STUDENT", "OWNER", True), ("STUDENT", "NOT_MEMBER", False), ("STUDENT", "NOT_MEMBER", False), ("", "NOT_MEMBER", False), ("STUDENT", "ADMIN", False), ("", "NOT_MEMBER", False),
    ]


def test_memory(spark):
    items = spark.createDataFrame([(1, "u", "m1", [1.0, 0.0]), (2, "u", None, [0.0, 0.0]), (3, "u", "m3", [1.0, 0.0]), (4, "v", "m4", [0.0, 1.0])], "id long, user_id string, memory string, embedding array<float>")
    assert [(r["id"], r["rank"]) for r in memory.recall(items, [2.0, 0.0]).orderBy("user_id", "rank").collect()] == [(1, 1), (3, 2)]
    assert memory.recall(items, [2.0, 0.0], threshold=None).count() == 4
    assert memory.facts(memory.recall(items, [2.0, 0.0])).first()["facts"] == "- m1\n- m3"
    gone = spark.createDataFrame([(1, "v"), (3, "u"), (9, "u")], "id long, user_id string")
    assert {r["id"] for r in memory.without(items, gone).collect()} == {1, 2, 4}


def test_mutations(spark, tmp_path):
    now = spark.createDataFrame([("a", "u", "old", False), ("b", "u", "old", False)], "session_id string, user_id string, title string, is_pinned boolean")
    changes = spark.createDataFrame([("a", 1, "one", None), ("a", 2, None, True), ("z", 1, "lost", None)], "session_id string, changed_at long, title string, is_pinned boolean")
    assert sorted(tuple(r) for r in mutations.updated(now, changes).collect()) == [("a", "u", "one", True), ("b", "u", "old", False)]
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, at long, v string")
    assert sorted(tuple(r) for r in mutations.latest(log, "k", "at").collect()) == [("a", 2, "y"), ("b", 1, None)]
    mutations.append(now, f"{tmp_path}/sessions")
    mutations.append(now.limit(0), f"{tmp_path}/sessions")
    assert spark.read.parquet(f"{tmp_path}/sessions").count() == 2
    mutations.send(spark.createDataFrame([("k", "{}")], "key string, value string"), "usage", path=str(tmp_path))
    assert spark.read.json(f"{tmp_path}/usage").count() == 1


def test_usage(spark):
    said = messages(spark, [("a", 1, "user", "x", 3), ("a", 2, "user", "x", 4), ("b", 1, "user", "", 0)])
    owners = spark.createDataFrame([("a", "u", "big"), ("b", "u", "none")], "session_id string, user_id string, model string")
    dimension = spark.createDataFrame([("big", 2)], "model string, model_type int")
    used = metering.usage(said, owners, dimension)
    assert [(r["user_id"], r["usage_tokens"], r["model_type"], r["weighted_tokens"]) for r in used.collect()] == [("u", 7, 2, 70)]


def test_streams(spark, tmp_path):
    """Two batches: the capped list is carried over, a call ends later."""
    schema = "session_id string, ordinal long, role string, content string, token_count long"
    for k in range(2):
        spark.createDataFrame([("a", 3 * k + i, "user", f"m{3 * k + i}", 2) for i in range(3)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    lists = mutations.latest(state.appended(state.hot_lists(stream, 4, seconds=None)), "session_id", "version").collect()
    assert [[m["ordinal"] for m in json.loads(r["messages"])] for r in lists] == [[2, 3, 4, 5]]
    assert [(r["usage_tokens"], r["n_messages"]) for r in state.updated(state.running_usage(stream), "session_id").collect()] == [(12, 6)]
    kind = "call string, seq long, content string, finish_reason string"
    spark.createDataFrame([("c", 2, "lo", None), ("d", 1, "x", None)], kind).coalesce(1).write.parquet(f"{tmp_path}/deltas")
    spark.createDataFrame([("c", 1, "hel", "stop")], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/deltas")
    deltas = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/deltas")
    assert [(r["call"], r["content"]) for r in state.appended(state.assembled_text(deltas)).collect()] == [("c", "hello")]


def test_post_turn(spark, tmp_path):
    sink = state.post_turn(str(tmp_path), lambda rows: rows.groupBy("session_id").agg(F.sum("token_count").alias("usageTokens")))
    batch = messages(spark, [("a", 1, "user", "twelve chars", None), ("a", 2, "assistant", "x", 5)])
    sink(batch, 0)
    sink(batch, 0)  # a retried batch
    assert spark.read.parquet(f"{tmp_path}/cold").count() == 2
    assert spark.read.parquet(f"{tmp_path}/cold").where("search_tokens = 'twelve chars'").count() == 1
    assert spark.read.json(f"{tmp_path}/usage").first()["usageTokens"] == 8


def test_post_turn_sinks_are_independent(spark, tmp_path):
    """A sink that fails is reported and stops no other; hot rows are capped."""
    (tmp_path / "hot").write_text("not a folder")
    failures = []
    usage = lambda rows: rows.groupBy("session_id").agg(F.sum("token_count").alias("usageTokens"))
    state.post_turn(str(tmp_path), usage, 2, lambda name, e: failures.append(name))(messages(spark, [("a", k, "user", "x", 1) for k in range(5)]), 0)
    assert failures == ["hot"] and spark.read.parquet(f"{tmp_path}/cold").count() == spark.read.parquet(f"{tmp_path}/memory").count() == 5
    assert spark.read.json(f"{tmp_path}/usage").first()["usageTokens"] == 5
    (tmp_path / "hot").unlink()
    for batch in range(2):
        state.post_turn(str(tmp_path), usage, 2)(messages(spark, [("a", 5 * batch + k, "user", "x", 1) for k in range(5)]), batch)
    hot = spark.read.parquet(f"{tmp_path}/hot")
    assert hot.count() == 4 and {r["ordinal"] for r in history.last_n(hot, 2).collect()} == {8, 9}


def test_time_to_live(spark, tmp_path):
    """A list that nobody writes to for its time to live starts again, and
    every write puts the end off."""
    import time

    schema = "session_id string, ordinal long, role string, content string, token_count long"

    def write(session, ordinal):
        spark.createDataFrame([(session, ordinal, "user", "x", 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    write("a", 1)
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    lists = state.hot_lists(stream, 5, seconds=6)
    query = lists.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="1 second").start()

    def version(n):
        """The versions of session a once it has been written ``n`` times."""
        for _ in range(120):
            rows = spark.read.schema(lists.schema).parquet(f"{tmp_path}/out").where("session_id = 'a'").collect() if (tmp_path / "out").exists() else []
            if len(rows) >= n:
                return sorted((r["version"], [m["ordinal"] for m in json.loads(r["messages"])]) for r in rows)
            time.sleep(0.5)
        raise AssertionError(query.exception() or "no row")

    try:
        assert version(1) == [(1, [1])]
        write("a", 2)
        assert version(2) == [(1, [1]), (2, [1, 2])]
        time.sleep(8)
        write("b", 1)  # a batch of another session
        time.sleep(3)
        write("a", 3)
        assert version(3) == [(1, [1]), (1, [3]), (2, [1, 2])]
    finally:
        query.stop()


def test_compression_end_to_end(spark):
    """The boundary is an ordinal; failed and blank summaries change nothing."""
    rows = messages(spark, [(s, o, "user", f"{s}{o}", 300) for s in "abcd" for o in range(4 if s != "d" else 1)])
    sessions = spark.createDataFrame([(s, "u", None, None, None) for s in "abcd"], "session_id string, user_id string, current_summary string, summary_ordinal long, summary_updated_at timestamp_ntz")

    def answer(prompt):
        if "b0" in prompt:
            raise RuntimeError("down")
        return "  " if "c0" in prompt else " all of it "

    changes, kept = state.compressed(rows, sessions, answer, AT)
    now = {r["session_id"]: r for r in mutations.updated(sessions, changes).collect()}
    assert (now["a"]["current_summary"], now["a"]["summary_ordinal"], now["a"]["summary_updated_at"]) == ("all of it", 2, AT)
    assert all(now[s]["current_summary"] is None for s in "bcd")
    assert [(r["session_id"], r["ordinal"]) for r in kept.collect()] == [("a", 3)]
    hot = context.replaced(context.hot(rows, 2), kept)
    assert sorted((r["session_id"], r["ordinal"]) for r in hot.collect()) == [("a", 3), ("b", 2), ("b", 3), ("c", 2), ("c", 3), ("d", 0)]


def test_history_tool(spark):
    rows = messages(spark, [("a", 1, "user", "Hello big world", 1), ("a", 2, "assistant", "WORLD x", 1)])
    asked = [(1, None, "world", None, None), (2, "a", "  ", None, None), (3, "a", "nothing", None, None), (4, "a", "world", "bad", "2000-01-01T00:00:00"), (5, "a", "world", None, "2000-01-01T00:00:00"), (6, "z", "world", None, None)]
    got = {r["request_id"]: r["output"] for r in search.history_tool(rows, spark.createDataFrame(asked, "request_id long, session_id string, keyword string, start_time string, end_time string")).collect()}
    assert got[1] == "[Tool Error] Missing session_id in execution context." and got[2] == "[Tool Error] Missing required argument: keyword."
    assert got[3] == "[Tool Result] No messages found for keyword: 'nothing'." and got[5] == got[6] == "[Tool Result] No messages found for keyword: 'world'."
    assert got[4] == "[user] (2024-01-01T00:00:00): Hello big world\n[assistant] (2024-01-01T00:00:00): WORLD x"
    tools = fragments.Registry()
    tools.register("search_history", "Looks through the session.", search.HISTORY_TOOL, lambda args: "")
    assert tools.schemas()[0]["function"]["parameters"]["required"] == ["keyword"]


def test_lookups_and_settings(spark):
    sessions = spark.createDataFrame([("a", "u")], "session_id string, user_id string")
    assert history.session(sessions, "a").first()["user_id"] == "u"
    with pytest.raises(LookupError):
        history.session(sessions, "z")
    spark.conf.set("spark.colloquy.contextTokens", "1000")
    spark.conf.set("spark.colloquy.standardModels", "a, b")
    try:
        laid = configured(spark)
    finally:
        spark.conf.unset("spark.colloquy.contextTokens")
        spark.conf.unset("spark.colloquy.standardModels")
    assert laid.high_budget == 800 and laid.standard_models == ("a", "b") and configured(spark) == SETTINGS
    models = spark.createDataFrame([("x", True), ("y", False), ("z", None)], "model string, is_active boolean")
    assert {r["model"] for r in metering.active(models).collect()} == {"x", "z"}
    items = spark.createDataFrame([(1, "u", "m", None)], "id long, user_id string, memory string, metadata map<string,string>")
    assert memory.listed(items).first()["metadata"] == {}
    ties = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "k string, at long, v string")
    assert all(mutations.latest(ties.repartition(n), "k", "at").first()["v"] == "y" for n in (1, 3))


def test_hooks(spark):
    rows = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "blank"), ("d", None)], "session_id string, prompt string")
    answers = {"good": " a summary ", "blank": "  "}
    done = hooks.completed(rows, lambda p: answers[p])
    assert {r["session_id"]: (r["answer"], r["error"]) for r in done.collect()} == {"a": (" a summary ", None), "b": (None, "KeyError: 'bad'"), "c": ("  ", None), "d": (None, None)}
    changes = hooks.summaries(done, F.lit(5))
    assert [tuple(r) for r in changes.collect()] == [("a", 5, "a summary")]
    owners = spark.createDataFrame([("a", "u")], "session_id string, user_id string")
    assert [tuple(r) for r in hooks.ingested(messages(spark, [("a", 1, "user", None, 1), ("b", 1, "user", "x", 1)]), owners).collect()] == [("u", "user", None)]
    zipped = spark.createDataFrame([(["x", "y"], [1, 2])], "c array<string>, r array<int>").select(hooks.with_results(F.col("c"), F.col("r"))).first()[0]
    assert [(z["call"], z["result"]) for z in zipped] == [("x", 1), ("y", 2)]
