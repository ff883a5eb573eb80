"""The tool loop against a plain loop, tools as table functions, turns without an end."""

import datetime as dt
import json
import os
import random
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from colloquy.functions import tools as T
from colloquy.operators import loop
from colloquy.streaming import state

cloudpickle.register_pickle_by_value(sys.modules[__name__])
AT = dt.datetime(2024, 1, 1)


def plain(history, ask, tools, most):
    """One turn after the other, as a back end runs it."""
    messages, first = list(history), len(history)
    for _ in range(most):
        try:
            content, calls = ask(messages)
        except Exception as e:  # noqa: BLE001
            content, calls = f"[System Error]: {e}", []
        calls = sorted(calls, key=lambda c: c[0])
        if not calls:
            messages.append(("assistant", content, None))
            return [m if isinstance(m, tuple) else (m["role"], m["content"], m.get("id")) for m in messages[first:]]
        messages.append({"role": "assistant", "content": content or None})
        for i, name, arguments in calls:
            try:
                given = json.loads(arguments)
                output = tools[name]({k: str(v) for k, v in given.items()}) if name in tools else f"[Tool Error] Unknown tool: {name}"
            except Exception as e:  # noqa: BLE001
                output = f"[Tool Execution Error]: {type(e).__name__}: {e}"
            messages.append({"role": "tool", "content": output, "id": i})
    messages.append({"role": "assistant", "content": loop.EXHAUSTED.format(most)})
    return [m if isinstance(m, tuple) else (m["role"], m["content"], m.get("id")) for m in messages[first:]]


def ask(messages):
    seed = messages[0]["content"]
    if seed == "breaks":
        raise RuntimeError("down")
    seen = sum(m["role"] == "tool" for m in messages)
    rng = random.Random(f"{seed}/{seen}")
    if rng.random() < 0.25:
        return f"answer {seen} {messages[-1]['content']}", []
    return rng.choice(["", "thinking"]), [(f"id{rng.randrange(100)}-{k}", rng.choice(["add", "fail", "nothing"]), json.dumps({"x": seen + k})) for k in range(rng.randrange(1, 4))]


def fail(arguments):
    raise KeyError("gone")


TOOLS = {"add": lambda a: str(int(a["x"]) + 1), "fail": fail}


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('loop')}/of"
    seeds = [(k, "breaks" if k == 7 else f"s{k}") for k in range(40)]
    turns = spark.createDataFrame(seeds, "turn long, seed string").select("turn", F.array(loop._message("user", F.col("seed"))).alias("history"))
    return loop.loop(turns, ask, TOOLS, folder, 4).collect(), seeds, folder


def test_loop_equals_a_plain_loop(done):
    rows, seeds, _ = done
    got = {r["turn"]: [(m["role"], m["content"], m["tool_call_id"]) for m in r["messages"]] for r in rows}
    assert len(rows) == len(seeds)
    for turn, seed in seeds:
        want = plain([{"role": "user", "content": seed}], ask, TOOLS, 4)
        assert [(r, c or None, i) for r, c, i in got[turn]] == [(r, c or None, i) for r, c, i in want]
    assert {r["exhausted"] for r in rows} == {True, False} and all(r["steps"] == 4 for r in rows if r["exhausted"])
    assert got[7] == [("assistant", "[System Error]: down", None)]


def test_closed_turns_are_not_read_again(spark, done):
    rows, _, folder = done
    ends = {r["turn"]: r["steps"] for r in rows if not r["exhausted"]}
    for step in range(4):
        answered = {r["turn"] for r in spark.read.parquet(f"{folder}/answered-{step}").select("turn").collect()}
        assert answered == {r["turn"] for r in rows if ends.get(r["turn"], 99) > step}
    assert len(os.listdir(folder)) == 8


def test_no_turns(spark, tmp_path):
    none = spark.createDataFrame([], f"turn long, history array<{loop.MESSAGE}>")
    assert loop.loop(none, ask, TOOLS, f"{tmp_path}/none").count() == 0


SCHEMA = {"type": "object", "properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["n"]}


def test_tool_functions(spark):
    T.register_tool(spark, "tripled", SCHEMA, lambda own, a: f"{own['session_id']}/{3 * a['n']}/{len(a.get('tags', []))}" if a["n"] else 1 // 0)
    rows = [("a", 1, 5, ["x"]), ("a", 2, None, None), ("b", 3, 0, []), ("b", 4, 7, None)]
    spark.createDataFrame(rows, "session_id string, call_id long, n long, tags array<string>").createOrReplaceTempView("asked_tools")
    got = {r["call_id"]: r["output"] for r in spark.sql("SELECT * FROM tripled(TABLE(asked_tools) PARTITION BY session_id)").collect()}
    assert got == {1: "a/15/1", 2: "[Tool Error] Missing required argument: n.", 3: "[Tool Execution Error]: ZeroDivisionError: integer division or modulo by zero", 4: "b/21/0"}
    for wrong, what in (("session_id, call_id, tags", "missing n"), ("session_id, call_id, n, 'x' AS other", "no parameter other"), ("session_id, call_id, 'x' AS n", "n is string"), ("call_id, n", "missing session_id")):
        by = "PARTITION BY session_id" if "session_id" in wrong else "PARTITION BY call_id"
        with pytest.raises(AnalysisException, match=what):
            spark.sql(f"SELECT * FROM tripled(TABLE(SELECT {wrong} FROM asked_tools) {by})")
    assert [f.dataType.simpleString() for f in T.schema_of(SCHEMA).fields] == ["bigint", "array<string>"]


@pytest.mark.parametrize("a_batch", [1, 4])
def test_turns_without_an_end(spark, tmp_path, a_batch):
    """Ends in time, too late, at the bound, twice and never; also where ends
    come before their starts."""
    at = lambda m: AT + dt.timedelta(minutes=m)
    starts = [[(1, at(0)), (2, at(1)), (3, at(2))], [(4, at(30)), (5, at(31))], [(6, at(300))], [(9, at(900))]]
    ends = [[(5, at(32))], [(1, at(5)), (2, at(12)), (4, at(40))], [(3, at(40)), (6, at(301)), (6, at(302))], [(9, at(901))]]
    for k in range(4):
        for name, parts in (("s", starts), ("e", ends)):
            spark.createDataFrame(parts[k], "turn long, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        time.sleep(0.02)
    read = lambda name, to: spark.readStream.schema("turn long, at timestamp").option("maxFilesPerTrigger", a_batch).parquet(f"{tmp_path}/{name}").withColumnRenamed("at", to)
    told = state.appended(state.outcomes(read("s", "started_at"), read("e", "ended_at"), "10 minutes", "60 minutes"))
    got = sorted((r["turn"], r["outcome"]) for r in told.collect())
    assert got == [(1, "finished"), (2, "aborted"), (3, "aborted"), (4, "finished"), (5, "finished"), (6, "finished"), (6, "finished"), (9, "finished")]
    said = spark.createDataFrame([(1, "kept"), (2, "lost"), (77, "unknown")], "turn long, content string")
    assert [r["content"] for r in state.persisted(said, told).collect()] == ["kept"]
