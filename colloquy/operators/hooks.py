"""Where a model or a store outside Spark is called: once for each row, on the
executors, in Arrow batches, a failure staying in its own row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completed(prompts: DataFrame, complete: Callable[[str], str], column: str = "prompt") -> DataFrame:
    """``prompts`` with ``answer`` and ``error``; a null prompt is not sent."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            answers, errors = [], []
            for text in rows[column]:
                answer = error = None
                if text is not None:
                    try:
                        answer = complete(text)
                    except Exception as e:  # noqa: BLE001  isolation is the contract
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield rows.assign(answer=pd.Series(answers, index=rows.index, dtype=object), error=pd.Series(errors, index=rows.index, dtype=object))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    return prompts.mapInPandas(run, f"{kinds}, answer string, error string")


def summaries(answered: DataFrame, at: Column) -> DataFrame:
    """Session changes from answers; blank answers and failures change nothing."""
    said = answered.where(F.col("error").isNull() & (F.trim(F.coalesce("answer", F.lit(""))) != ""))
    return said.select("session_id", at.alias("changed_at"), F.trim("answer").alias("current_summary"))


def ingested(messages: DataFrame, owners: DataFrame) -> DataFrame:
    """(user_id, role, content) rows for the memory store; null content stays."""
    return messages.join(owners.select("session_id", "user_id"), "session_id").select("user_id", "role", "content")


def with_results(calls: Column, results: Column) -> Column:
    """Calls and their results side by side, by position."""
    return F.zip_with(calls, results, lambda c, r: F.struct(c.alias("call"), r.alias("result")))
