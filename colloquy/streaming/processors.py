"""Keyed state as Spark's list, map and value states.

``transformWithState`` needs the RocksDB state store, which the functions here
name for the session if it names none. State grows by appends of what is new;
it is read where a list is emitted, and written anew only to cap it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..settings import SETTINGS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb(spark: SparkSession) -> None:
    """Names the RocksDB state store, where the session names no store."""
    if spark.conf.get(_PROVIDER, None) in (None, _DEFAULT):
        spark.conf.set(_PROVIDER, _ROCKSDB)


def _values(item) -> tuple:
    return tuple(item.values()) if isinstance(item, dict) else tuple(item)


class HotList(StatefulProcessor):
    """The newest ``n`` messages of a session, by ordinal. Elements are
    appended; once there are twice as many as wanted the list is cut, so state
    has at most ``2 n`` elements and a write costs its own rows on average.

    With ``seconds``, a list that has not been written for so long is gone: the
    state store drops elements by its own time to live, of half as long again,
    and a list is written anew, and so lives on, when half of ``seconds`` have
    passed since that was done last."""

    def __init__(self, n: int, seconds: int | None, message: str, columns: list[str]):
        self.n, self.seconds, self.message, self.columns = n, seconds, message, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.seconds is None else 1500 * self.seconds
        self.items = handle.getListState("items", self.message, ttl)
        self.about = handle.getValueState("about", "version long, held long, written long, fresh long", ttl)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """A session's list as the cold table has it: one row with ``items``."""
        held = sorted((_values(x) for x in initialState["items"] or []), key=lambda x: x[0])[-self.n :]
        if held:
            now = self._now(timerValues)
            self.items.put(held)
            self.about.update((len(initialState["items"]), len(held), now, now))

    def _now(self, timer) -> int:
        return 0 if self.seconds is None else timer.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self._now(timerValues)
        version, held, written, fresh = self.about.get() if self.about.exists() else (0, 0, now, now)
        if self.seconds is not None and now - written >= 1000 * self.seconds:
            self.items.clear()
            version, held, fresh = 0, 0, now
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if new:
            self.items.appendList(new)
        every = sorted((tuple(x) for x in self.items.get()), key=lambda x: x[0])
        version, held = version + len(new), held + len(new)
        if held >= 2 * self.n or (self.seconds is not None and now - fresh >= 500 * self.seconds):
            self.items.put(every[-self.n :])
            held, fresh = min(held, self.n), now
        self.about.update((version, held, now, fresh))
        yield Row(session_id=key[0], version=version, messages=[dict(zip(self.columns, x, strict=True)) for x in every[-self.n :]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def hot_lists(messages: DataFrame, n: int = SETTINGS.hot_messages, seconds: int | None = SETTINGS.hot_seconds, initial: DataFrame | None = None) -> DataFrame:
    """(session_id, version, messages): a session's capped list, as an array of
    all other columns, after each batch that writes to it; ``version`` counts
    its messages so far. ``ordinal`` orders. ``initial`` are the cold table's
    messages, of the same columns, with which lists begin."""
    rocksdb(messages.sparkSession)
    columns = ["ordinal", *(c for c in messages.columns if c not in ("session_id", "ordinal"))]
    message = F.struct(*columns)
    kind = messages.select(message.alias("m")).schema["m"].dataType
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)
    cold = initial and initial.groupBy("session_id").agg(F.collect_list(message).alias("items")).groupBy("session_id")
    out = "session_id string, version long, messages array<struct<" + ", ".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in kind.fields) + ">>"
    mode = "none" if seconds is None else "processingtime"
    return messages.select("session_id", *columns).groupBy("session_id").transformWithState(HotList(n, seconds, fields, columns), out, "append", mode, cold)


_PART = "seq long, tie long, index int, id string, name string, arguments string, content string"
COMPLETION = "completion long, content string, finish_reason string, tool_calls array<struct<index:int,id:string,name:string,arguments:string>>"


class Completions(StatefulProcessor):
    """A call's fragments, appended until its end comes. Fragments of a call
    come in order of ``seq`` from batch to batch, in any order within one, so
    what is emitted does not depend on how a stream is cut. What comes after an
    end begins the call's next completion. With ``seconds``, a call that gets
    nothing for so long ends without a reason."""

    def __init__(self, seconds: int | None):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", _PART)
        self.count = handle.getValueState("count", "n long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, timer = self.count.get() if self.count.exists() else (0, 0)
        own: list[tuple] = []
        for r in sorted(rows, key=lambda r: (r["seq"], r["tie"])):
            own.append((r["seq"], r["tie"], r["index"], r["id"], r["name"], r["arguments"], r["content"]))
            if r["finish_reason"] is not None:
                yield self._completed(key, n, [*self.parts.get(), *own], r["finish_reason"])
                self.parts.clear()
                own, n = [], n + 1
        if own:
            self.parts.appendList(own)
        if self.seconds is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds if own or self.parts.exists() else 0
            if timer:
                self.handle.registerTimer(timer)
        self.count.update((n, timer))

    def _completed(self, key, n: int, parts: Iterable[tuple], reason: str | None) -> Row:
        calls: dict[int, list] = {}
        content = []
        for _, _, index, name_id, name, arguments, text in sorted((tuple(p) for p in parts), key=lambda p: p[:2]):
            if text is not None:
                content.append(text)
            if index is not None and any(x is not None for x in (name_id, name, arguments)):
                own = calls.setdefault(index, ["", [], []])
                own[0] = name_id or own[0]
                own[1].append(name or "")
                own[2].append(arguments or "")
        made = [{"index": i, "id": x[0], "name": "".join(x[1]), "arguments": "".join(x[2])} for i, x in sorted(calls.items())]
        return Row(call=key[0], completion=n, content="".join(content), finish_reason=reason, tool_calls=made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, _ = self.count.get()
        if self.parts.exists():
            yield self._completed(key, n, self.parts.get(), None)
            self.parts.clear()
            n += 1
        self.count.update((n, 0))

    def close(self) -> None:
        pass


def _whole(deltas: DataFrame) -> DataFrame:
    """``deltas`` with all columns that the processors read; ``tie`` orders
    fragments of one ``seq``."""
    for name, kind in (("tie", "long"), ("index", "int"), ("id", "string"), ("name", "string"), ("arguments", "string")):
        if name not in deltas.columns:
            deltas = deltas.withColumn(name, (F.lit(0) if name == "tie" else F.lit(None)).cast(kind))
    rocksdb(deltas.sparkSession)
    return deltas


def completions(deltas: DataFrame, seconds: int | None = None) -> DataFrame:
    """(call, completion, content, finish_reason, tool_calls): a row when a
    call's end comes; ``completion`` counts a call's ends from 0."""
    kind = deltas.schema["call"].dataType.simpleString()
    return _whole(deltas).groupBy("call").transformWithState(Completions(seconds), f"call {kind}, {COMPLETION}", "append", "none" if seconds is None else "processingtime")


class Texts(StatefulProcessor):
    """The whole text of a call that has ended, again whenever more of it
    comes; ``version`` counts its fragments."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "seq long, content string")
        self.about = handle.getValueState("about", "version long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, ended = self.about.get() if self.about.exists() else (0, False)
        new = [(r["seq"], r["content"], r["finish_reason"]) for r in rows]
        said = [(seq, content) for seq, content, _ in new if content is not None]
        if said:
            self.parts.appendList(said)
        version, ended = version + len(new), ended or any(x[2] is not None for x in new)
        self.about.update((version, ended))
        if ended:
            yield Row(call=key[0], version=version, content="".join(c for _, c in sorted(tuple(p) for p in self.parts.get())))

    def close(self) -> None:
        pass


def texts(deltas: DataFrame) -> DataFrame:
    """(call, version, content): the latest version of a call is the same
    however the stream is cut into batches."""
    kind = deltas.schema["call"].dataType.simpleString()
    return _whole(deltas).groupBy("call").transformWithState(Texts(), f"call {kind}, version long, content string", "append", "none")
