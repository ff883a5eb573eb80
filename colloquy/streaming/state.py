"""Keyed state over message streams.

Event-time watermarks are Spark's: the reference's marks are token budgets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_tokens
from ..operators.context import window
from ..operators.history import last_n
from ..operators.hooks import completed, summaries
from ..operators.mutations import latest
from ..operators.prompts import summary_input
from ..settings import SETTINGS
from ..sources.tables import fragments_of, token_estimate
from . import processors


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared one that spark.checkpoint.dir names."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{root}/stream-{uuid.uuid4().hex}"


def message_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 64) -> DataFrame:
    """``conversations`` as a stream of messages."""
    path = f"{sf_dir}/conversations.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path + "*")
    return raw.withColumn("content", F.col("text")).select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("ordinal"), "role", "content", token_estimate().alias("token_count"), "conv_id"
    )


def delta_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 64) -> DataFrame:
    """``events`` as a stream of text fragments, as ``tables.deltas`` has them."""
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path + "*")
    fragments = fragments_of(raw)
    return fragments.select("call", "seq", F.col("event_id").alias("tie"), "index", "id", "name", "arguments", "content", "finish_reason")


def hot_lists(messages: DataFrame, n: int = SETTINGS.hot_messages, seconds: int | None = SETTINGS.hot_seconds, initial: DataFrame | None = None) -> DataFrame:
    """``processors.hot_lists`` with each list as one JSON text. A time to live
    keeps a stream busy, so a run over what is there now (``availableNow``)
    takes ``seconds=None``."""
    lists = processors.hot_lists(messages, n, seconds, initial)
    return lists.withColumn("messages", F.to_json("messages", {"ignoreNullFields": "false"}))


def running_usage(messages: DataFrame) -> DataFrame:
    """Tokens of each session so far."""
    return messages.groupBy("session_id").agg(F.sum("token_count").alias("usage_tokens"), F.count("*").alias("n_messages"))


def assembled_text(deltas: DataFrame) -> DataFrame:
    """(call, version, content) of the calls that have ended; the row of the
    greatest version counts, whatever the batches were."""
    return processors.texts(deltas)


def outcomes(starts: DataFrame, ends: DataFrame, within: str, late: str) -> DataFrame:
    """(turn, started_at, ended_at, outcome): a turn that ends ``within`` a
    time is finished; one that does not is aborted, which is told once no end
    in time can come any more, by the watermark of events up to ``late``. So
    what an aborted turn made is known and need not be kept. This is an
    addition: a back end sees its caller leave, a stream sees no end."""
    begun = starts.withWatermark("started_at", late).select("turn", "started_at")
    done = ends.withWatermark("ended_at", late).select(F.col("turn").alias("ended_turn"), "ended_at")
    on = (F.col("turn") == F.col("ended_turn")) & F.expr(f"ended_at >= started_at AND ended_at <= started_at + INTERVAL {within}")
    met = begun.join(done, on, "left_outer")
    return met.select("turn", "started_at", "ended_at", F.when(F.col("ended_at").isNull(), "aborted").otherwise("finished").alias("outcome"))


def persisted(messages: DataFrame, told: DataFrame) -> DataFrame:
    """The messages of turns that finished; an aborted turn leaves none."""
    return messages.join(told.where("outcome = 'finished'").select("turn"), "turn", "left_semi")


def appended(stream: DataFrame) -> DataFrame:
    """Run an append stream over what its source holds now; its rows, written
    once each by the file sink."""
    out = scratch(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def updated(stream: DataFrame, key: str) -> DataFrame:
    """Run an update stream over what its source holds now; the latest row of
    each key. A micro-batch overwrites its own folder, so a retry writes once."""
    out, spark = scratch(stream.sparkSession), stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/part={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return latest(spark.read.parquet(f"{out}/rows").drop("part"), key, "batch").drop("batch")


def post_turn(root: str, usage: Callable[[DataFrame], DataFrame], n: int = SETTINGS.hot_messages, failed: Callable[[str, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of a finished turn: the hot rows, cold messages and
    memory rows, each to its own folder of the batch, then usage. A batch adds
    at most ``n`` hot rows a session; ``last_n`` over the folders is the list.
    A retried batch overwrites what it wrote. A failure of one of the first three goes to
    ``failed`` and stops no other; one of usage fails the batch, which Spark
    then runs again."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            filled = rows.withColumn("token_count", F.coalesce("token_count", token_estimate()))
            searched = filled.withColumn("search_tokens", F.when(F.col("content") != "", search_tokens(F.col("content"))))
            sinks = {
                "hot": lambda: last_n(filled, n).drop("age").write.mode("overwrite").parquet(f"{root}/hot/part={batch}"),
                "cold": lambda: searched.write.mode("overwrite").parquet(f"{root}/cold/part={batch}"),
                "memory": lambda: filled.select("session_id", "role", "content").write.mode("overwrite").parquet(f"{root}/memory/part={batch}"),
            }
            for name, sink in sinks.items():
                try:
                    sink()
                except Exception as e:  # noqa: BLE001  isolation is the contract
                    if failed:
                        failed(name, e)
            usage(filled).write.mode("overwrite").json(f"{root}/usage/part={batch}")
        finally:
            rows.unpersist()

    return write


def compressed(messages: DataFrame, sessions: DataFrame, complete: Callable[[str], str], at) -> tuple[DataFrame, DataFrame]:
    """Summarise and compress, for every session over its high mark: (session
    changes with the new summary and the ordinal of the last message that it
    covers, the rows that its hot list is replaced by). A session whose summary
    fails or is blank appears in neither. ``at`` is the time of the change. The
    boundary is an ordinal, as times are not unique."""
    spread = window(messages)
    answered = completed(summary_input(spread, sessions, only_flagged=True), complete)
    covered = spread.where("bucket = 'compress' AND needs_compression").groupBy("session_id").agg(F.max("ordinal").alias("summary_ordinal"))
    changes = summaries(answered, F.lit(at)).join(covered, "session_id").withColumn("summary_updated_at", F.lit(at))
    keep = spread.where("bucket = 'keep'").join(changes.select("session_id"), "session_id", "left_semi")
    return changes, keep.select(*messages.columns)
