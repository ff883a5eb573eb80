"""Token counts by byte-pair vocabularies.

A text is split into pieces in the JVM; a piece's bytes are merged, the pair of
the lowest rank first, until no pair is in the vocabulary. Ranks come from
public vocabulary files, whose folder is a parameter; nothing is trained.
"""

from __future__ import annotations

import base64
import heapq
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where vocabulary files of (base64 bytes, rank) lines are.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits a text before its bytes are merged.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Which vocabulary counts for the models whose names begin so; any other model
#: falls back to ``DEFAULT``.
ENCODINGS = {"gpt-4o": "byte_bpe_multi_50k", "gpt": "byte_bpe_50k"}
DEFAULT = "byte_bpe_50k"


def ranks(name: str, folder: str = FOLDER) -> dict[bytes, int]:
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


def merged(piece: bytes, known: dict[bytes, int]) -> list[bytes]:
    """The tokens of a piece. A heap holds the pairs by rank, then place; a
    pair whose parts have gone into others since is passed over."""
    n = len(piece)
    if n < 2 or piece in known:
        return [piece] if piece else []
    size, before, after = [1] * n, list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (rank := known.get(piece[i : j + size[j]])) is not None:
            heapq.heappush(heap, (rank, i, j + size[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not size[i] or j < 0 or j + size[j] != end:
            continue
        size[i], size[j], after[i] = end - i, 0, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i >= 0:
        out.append(piece[i : i + size[i]])
        i = after[i]
    return out


def pieces(text: Column) -> Column:
    """A text's pieces, in the JVM; white space as Unicode has it."""
    return F.regexp_extract_all(text, F.lit(f"(?U){SPLIT}"), F.lit(0))


def encoding_of(model: Column, encodings: dict[str, str] = ENCODINGS, default: str = DEFAULT) -> Column:
    """The vocabulary of a model's name, by the longest beginning that fits."""
    found = F.lit(default)
    for start in sorted(encodings, key=len):
        found = F.when(model.startswith(start), encodings[start]).otherwise(found)
    return found


def counted(rows: DataFrame, text: Column, encoding: Column, names: tuple[str, ...] = (*ENCODINGS.values(), DEFAULT), folder: str = FOLDER, name: str = "tokens") -> DataFrame:
    """``rows`` with the number of tokens of ``text`` by ``encoding``, which is
    one of ``names``; null and empty texts count 0. A piece's count is kept, as
    most come again."""
    sent = rows.sparkSession.sparkContext.broadcast({n: ranks(n, folder) for n in dict.fromkeys(names)})

    @F.pandas_udf("long")
    def run(parts: pd.Series, by: pd.Series) -> pd.Series:
        kept: dict[tuple[str, str], int] = {}
        totals = []
        for own, which in zip(parts, by, strict=True):
            total = 0
            for p in own if own is not None else ():
                if (which, p) not in kept:
                    kept[which, p] = len(merged(p.encode(), sent.value[which]))
                total += kept[which, p]
            totals.append(total)
        return pd.Series(totals, dtype="int64")

    return rows.withColumn(name, run(pieces(text), encoding))
