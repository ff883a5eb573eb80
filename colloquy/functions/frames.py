"""Event frames: ``data: <json>`` and a blank line, one for each row.

JSON is compact and UTF-8; compare it as JSON, not as bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of frame and their fields, in order.
FIELDS = {
    "start": ("messageId",),
    "text-start": ("id",),
    "text-delta": ("id", "delta"),
    "text-end": ("id",),
    "reasoning-start": ("id",),
    "reasoning-delta": ("id", "delta"),
    "reasoning-end": ("id",),
    "source-url": ("sourceId", "url"),
    "source-document": ("sourceId", "mediaType", "title"),
    "file": ("url", "mediaType"),
    "error": ("errorText",),
    "tool-input-start": ("toolCallId", "toolName"),
    "tool-input-delta": ("toolCallId", "inputTextDelta"),
    "tool-input-available": ("toolCallId", "toolName", "input"),
    "tool-output-available": ("toolCallId", "output"),
    "start-step": (),
    "finish-step": (),
    "finish": (),
    "abort": ("reason",),
}


def _framed(payload: Column) -> Column:
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def frame(kind: str, **fields: Column) -> Column:
    """A frame of a known kind; its fields are all required."""
    wanted = FIELDS[kind]
    if set(fields) != set(wanted):
        raise ValueError(f"{kind} takes {wanted}, not {tuple(fields)}")
    return _framed(F.to_json(F.struct(F.lit(kind).alias("type"), *[fields[name].alias(name) for name in wanted])))


def data_frame(kind: str, data: Column) -> Column:
    return _framed(F.to_json(F.struct(F.lit(f"data-{kind}").alias("type"), data.alias("data"))))


def done() -> Column:
    return _framed(F.lit("[DONE]"))
