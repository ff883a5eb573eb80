"""The tool loop of a turn as a fixpoint over the turns that are still open.

A round asks a model about every open turn, runs the tools that it calls, each
call a row of its own, and appends the answers. A turn whose answer calls no
tool closes. Each round is written to a folder of its own and the next reads
only what that one left open, so closed turns are never read again and a lost
executor costs a round's tasks at most. After ``most`` rounds what is open ends
with the text of exhaustion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import SETTINGS
from .fragments import run_tools

CALLS = "array<struct<id:string,name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_call_id:string,name:string,tool_calls:{CALLS}>"
#: Fixed value: the text of a turn that runs out of rounds.
EXHAUSTED = "Agent 推理超出最大迭代次数（{}），未能生成最终答案"

#: From a turn's messages, as dicts, to its answer: text, and calls as (id, name, arguments).
Ask = Callable[[list[dict]], tuple[str | None, list[tuple[str, str, str]]]]


def _message(role: str | Column, content: Column, call: Column | None = None, name: Column | None = None, calls: Column | None = None) -> Column:
    none = F.lit(None)
    text = lambda c: (none if c is None else c).cast("string")
    return F.struct(F.lit(role).alias("role"), text(content).alias("content"), text(call).alias("tool_call_id"), text(name).alias("name"), (none if calls is None else calls).cast(CALLS).alias("tool_calls"))


def _asked(turns: DataFrame, ask: Ask) -> DataFrame:
    """``turns`` with ``content`` and ``calls``, by id. A model that fails
    closes its turn with the error as its text."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            said = []
            for history in rows["history"]:
                messages = [m if isinstance(m, dict) else m.asDict(recursive=True) for m in history]
                try:
                    content, calls = ask(messages)
                except Exception as e:  # noqa: BLE001  a turn's failure is its own
                    content, calls = f"[System Error]: {e}", []
                said.append((content, [dict(zip(("id", "name", "arguments"), c, strict=True)) for c in sorted(calls, key=lambda c: c[0])]))
            yield rows.assign(content=[s[0] for s in said], calls=[s[1] for s in said])

    kind = turns.schema["turn"].dataType.simpleString()
    return turns.select("turn", "first", "history").mapInPandas(run, f"turn {kind}, first int, history array<{MESSAGE}>, content string, calls {CALLS}")


def loop(turns: DataFrame, ask: Ask, tools: dict[str, Callable[[dict], str]], folder: str, most: int = SETTINGS.tool_rounds) -> DataFrame:
    """(turn, steps, exhausted, messages): ``turns`` (turn, history) with the
    messages that the loop appended. ``folder`` is a new shared one."""
    spark = turns.sparkSession

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    def ended(rows: DataFrame, history: Column, steps: int, exhausted: bool) -> DataFrame:
        added = F.slice(history, F.col("first") + 1, F.size(history))
        return rows.select("turn", F.lit(steps).alias("steps"), F.lit(exhausted).alias("exhausted"), added.alias("messages"))

    left = turns.select("turn", F.size("history").alias("first"), F.col("history").cast(f"array<{MESSAGE}>").alias("history"))
    closed = []
    for step in range(most):
        said = kept(_asked(left, ask), f"answered-{step}")
        closed.append(ended(said.where(F.size("calls") == 0), F.concat("history", F.array(_message("assistant", F.col("content")))), step + 1, False))
        calling = said.where(F.size("calls") > 0)
        each = calling.select(F.col("turn").alias("call"), F.posexplode("calls").alias("at", "c")).select("call", F.col("at").cast("string").alias("id"), "c.name", "c.arguments")
        outputs = run_tools(each, tools).groupBy(F.col("call").alias("turn")).agg(F.map_from_entries(F.collect_list(F.struct("id", "output"))).alias("outputs"))
        asked = _message("assistant", F.nullif("content", F.lit("")), calls=F.col("calls"))
        results = F.transform("calls", lambda c, i: _message("tool", F.element_at("outputs", i.cast("string")), c["id"], c["name"]))
        left = kept(calling.join(outputs, "turn").select("turn", "first", F.concat("history", F.array(asked), results).alias("history")), f"open-{step}")
        if left.isEmpty():
            break
    else:
        closed.append(ended(left, F.concat("history", F.array(_message("assistant", F.lit(EXHAUSTED.format(most))))), most, True))
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out
