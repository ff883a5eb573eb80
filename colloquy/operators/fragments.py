"""Assembly of streamed fragments, tool calls and their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_arguments
from ..settings import SETTINGS


def _in_order(value: Column) -> Column:
    """The non-null values of a group by ``seq``, joined. The result is one
    call's text, so its size is that of the output."""
    parts = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("seq", value.alias("x")))))
    return F.array_join(F.transform(parts, lambda p: p["x"]), "")


def texts(deltas: DataFrame) -> DataFrame:
    """(call, content, finish_reason): text in order, the last reason wins."""
    reason = F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq")))
    return deltas.groupBy("call").agg(_in_order(F.col("content")).alias("content"), F.coalesce(reason, F.lit("stop")).alias("finish_reason"))


def calls(deltas: DataFrame) -> DataFrame:
    """(call, index, id, name, arguments): the last non-empty id, name and
    arguments joined in order."""
    last_id = F.max_by("id", F.when(F.coalesce("id", F.lit("")) != "", F.col("seq")))
    return deltas.groupBy("call", "index").agg(
        F.coalesce(last_id, F.lit("")).alias("id"), _in_order(F.col("name")).alias("name"), _in_order(F.col("arguments")).alias("arguments")
    )


def call_arrays(assembled: DataFrame) -> DataFrame:
    """(call, tool_calls): the protocol's array, by id as a string."""
    one = F.struct(
        "id", F.lit("function").alias("type"), F.struct("name", F.to_json(json_arguments(F.col("arguments"))).alias("arguments")).alias("function")
    )
    return assembled.groupBy("call").agg(F.array_sort(F.collect_list(one)).alias("tool_calls"))


def dispatched(assembled: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls with what their tool's row says; an unknown name is an error text.
    ``tools`` (name, output) is a small registry."""
    missing = F.concat(F.lit("[Tool Error] Unknown tool: "), F.coalesce("name", F.lit("")))
    return assembled.join(tools, "name", "left").withColumn("output", F.coalesce("output", missing))


def run_tools(assembled: DataFrame, tools: dict[str, Callable[[dict], str]]) -> DataFrame:
    """Each call run on the executors; a failure becomes the call's result and
    stops no other."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = []
            for name, args in zip(rows["name"], rows["args"], strict=True):
                tool = tools.get(name)
                try:
                    out.append(tool(dict(args or {})) if tool else f"[Tool Error] Unknown tool: {name}")
                except Exception as e:  # noqa: BLE001  isolation is the contract
                    out.append(f"[Tool Execution Error]: {type(e).__name__}: {e}")
            yield pd.DataFrame({"call": rows["call"], "id": rows["id"], "output": out})

    asked = assembled.select("call", "id", "name", json_arguments(F.col("arguments")).alias("args"))
    kind = asked.schema["call"].dataType.simpleString()
    return asked.mapInPandas(run, f"call {kind}, id string, output string")


class Registry:
    """Tools by name: registering again replaces, an unknown name raises."""

    def __init__(self) -> None:
        self._tools: dict[str, tuple[str, dict, Callable[[dict], str]]] = {}

    def register(self, name: str, description: str, parameters: dict, run: Callable[[dict], str]) -> None:
        self._tools[name] = (description, parameters, run)

    def get(self, name: str) -> Callable[[dict], str]:
        return self._tools[name][2]

    def schemas(self) -> list[dict]:
        return [{"type": "function", "function": {"name": n, "description": d, "parameters": p}} for n, (d, p, _) in self._tools.items()]

    def functions(self) -> dict[str, Callable[[dict], str]]:
        return {n: t[2] for n, t in self._tools.items()}

    def __len__(self) -> int:
        return len(self._tools)


def rounds(messages: DataFrame, most: int = SETTINGS.tool_rounds) -> DataFrame:
    """Assistant steps of each session and whether they exceed the loop's cap."""
    steps = messages.groupBy("session_id").agg(F.count(F.when(F.col("role") == "assistant", 1)).alias("steps"))
    return steps.select("session_id", F.least("steps", F.lit(most).cast("long")).alias("steps"), (F.col("steps") > most).alias("exhausted"))


def wire(messages: DataFrame) -> DataFrame:
    """The provider's message: role and content; the other keys only where they
    are neither null nor empty."""
    extra = [F.nullif(c, F.lit("")).alias(c) for c in ("tool_call_id", "name") if c in messages.columns]
    if "tool_calls" in messages.columns:
        extra.insert(0, F.when(F.size("tool_calls") > 0, F.col("tool_calls")).alias("tool_calls"))
    return messages.withColumn("wire", F.to_json(F.struct("role", F.coalesce("content", F.lit("")).alias("content"), *extra)))


def appended(column: Column, n: Column) -> Column:
    """The elements after position ``n`` of an array."""
    return F.slice(column, n + 1, F.greatest(F.size(column) - n, F.lit(0)))
