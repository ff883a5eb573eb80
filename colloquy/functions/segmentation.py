"""Words of scripts without spaces: a dictionary, a word graph, a Markov chain.

The dictionary is learnt from a column of spaced text by counting in Spark. A
text is cut block by block, a block being a run of letters. Of all ways through
the graph of a block's dictionary words the most probable is taken; runs of
single characters that this leaves are cut again by a chain of the states
begin, middle, end and single, with the emissions and transitions of all words
of the column. For searching, a word also gives the known words of two and
three characters inside it.

The graphs of a batch's blocks are searched together in NumPy: one step takes
the same place, counted from the end, of all blocks at once. The sums and their
order are those of ``Segmenter.best``, so the ways are the same.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORDS

_BLOCK = re.compile(r"\d+|[^\W\d_]+")
BEGIN, MIDDLE, END, SINGLE = range(4)
#: The states that may stand before each.
_BEFORE = {BEGIN: (END, SINGLE), MIDDLE: (BEGIN, MIDDLE), END: (BEGIN, MIDDLE), SINGLE: (END, SINGLE)}
_NEVER = -1e9
#: Characters that are searched together, and of the longest block among them:
#: a longer one would make many steps with few blocks each.
_TOGETHER, _LONGEST_BLOCK = 1 << 18, 1 << 11
#: Entries of a table by first letters.
_HEADS = 1 << 21


class Trie:
    """The words of two characters and more as arrays: a hash table of (node,
    character) to node with linear probing, and each node's word."""

    def __init__(self, words: dict[str, float]):
        letters = {c: k for k, c in enumerate(sorted({c for w in words for c in w}), 1)}
        #: By code point, 0 for a character that no word has.
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.width, nodes, keys, worth = len(letters) + 1, {"": 0}, [], [-np.inf]
        for word, w in words.items():
            for k in range(1, len(word) + 1):
                if word[:k] not in nodes:
                    nodes[word[:k]] = len(nodes)
                    keys.append(nodes[word[: k - 1]] * self.width + letters[word[k - 1]])
                    worth.append(-np.inf)
            worth[nodes[word]] = w
        # The last is that of no node, -1.
        self.worth = np.array([*worth, -np.inf])
        #: Whether longer words begin with it.
        self.inner = np.zeros(len(worth) + 1, bool)
        bits = max(4, (2 * len(worth)).bit_length())
        self.key, self.node, self.shift = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.uint64(64 - bits)
        key, node = np.array(keys, np.int64), np.arange(1, len(worth), dtype=np.int32)
        self.inner[key // self.width] = True
        #: Nodes by their first letters, read as digits, while such a table is small.
        self.heads: list[np.ndarray] = []
        held = {0: 0}
        while len(self.heads) < 3 and self.width ** (len(self.heads) + 1) <= _HEADS:
            here = np.flatnonzero(np.isin(key // self.width, list(held)))
            held = {int(n): held[k // self.width] * self.width + k % self.width for n, k in zip(node[here], key[here].tolist(), strict=True)}
            self.heads.append(np.full(self.width ** (len(self.heads) + 1), -1, np.int32))
            self.heads[-1][list(held.values())] = list(held)
        at = self._place(key)
        while len(key):
            free = self.key[at] < 0
            self.key[at[free]] = key[free]
            mine = self.key[at] == key
            self.node[at[mine]] = node[mine]
            key, node, at = key[~mine], node[~mine], (at[~mine] + 1) & (len(self.key) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node after ``letter``, -1 where no word goes on so."""
        key = node.astype(np.int64) * self.width + letter
        at = self._place(key)
        there = self.key[at]
        out = np.where(there == key, self.node[at], np.int32(-1))
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.key) - 1)
            there = self.key[at[left]]
            found = there == key[left]
            out[left[found]] = self.node[at[left[found]]]
            left = left[~found & (there >= 0)]
        return out


class _Inside(dict):
    """For a word the known words of two and three characters inside it, then
    the word, joined by spaces; empty for one character. Words of the
    dictionary are kept."""

    def __init__(self, words: dict[str, float]):
        self.words = words

    def __missing__(self, word: str) -> str:
        found = [part for size in (2, 3) if len(word) > size for k in range(len(word) - size + 1) if (part := word[k : k + size]) in self.words]
        joined = " ".join([*found, word]) if len(word) > 1 else ""
        if word in self.words:
            self[word] = joined
        return joined


@dataclass
class Segmenter:
    """``words``: the log of each word's share. ``emit``: for a character the
    log of its share in each state. ``turn``: the log of each transition."""

    words: dict[str, float]
    emit: dict[str, tuple[float, ...]]
    turn: dict[tuple[int, int], float]
    unknown: float
    unseen: float
    longest: int = field(init=False)
    open: set[str] = field(init=False)

    def __post_init__(self) -> None:
        self.open = {w[:k] for w in self.words for k in range(1, len(w))}
        self.longest = max(map(len, self.words), default=1)

    def best(self, block: str) -> list[str]:
        """The most probable way through the word graph, the longer word first
        where two are equal."""
        n, known, begun = len(block), self.words, self.open
        worth, step = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            part, at = block[i], i + 1
            most = known.get(part, self.unknown) + worth[at]
            for j in range(i + 2, min(i + self.longest, n) + 1):
                if part not in begun:
                    break
                part = block[i:j]
                if part in known and known[part] + worth[j] >= most:
                    most, at = known[part] + worth[j], j
            worth[i], step[i] = most, at
        out, i = [], 0
        while i < n:
            out.append(block[i : step[i]])
            i = step[i]
        return out

    @cached_property
    def trie(self) -> Trie:
        """Made in each worker at its first use, not sent."""
        return Trie(self.words)

    def best_of(self, blocks: list[str]) -> list[list[str]]:
        """``best`` of each block, all together."""
        out: list[list[str] | None] = [None] * len(blocks)
        short = []
        for k, b in enumerate(blocks):
            if len(b) > _LONGEST_BLOCK:
                out[k] = self.best(b)
            elif b:
                short.append(k)
            else:
                out[k] = []
        short.sort(key=lambda k: -len(blocks[k]))
        held, size = [], 0
        for k in [*short, None]:
            if k is None or size >= _TOGETHER:
                for at, way in zip(held, self._together([blocks[x] for x in held]) if held else (), strict=True):
                    out[at] = way
                held, size = [], 0
            if k is not None:
                held.append(k)
                size += len(blocks[k])
        return out

    def _together(self, blocks: list[str]) -> list[list[str]]:
        """The best ways through blocks that fall in length. Cells are
        (place from the end, block), place by place, so a place's blocks stand
        together and the next character of a cell has a place less."""
        sizes = np.array([len(b) for b in blocks])
        # A mark ends each block; no word has it.
        text = np.frombuffer(("\0".join(blocks) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        most, marked = int(sizes[0]), sizes + 1
        # How many blocks have a place, and where its cells begin; place 0 is the mark.
        having = len(blocks) - np.searchsorted(sizes[::-1], np.arange(most + 1))
        first = np.concatenate([[0], np.cumsum(having)]).astype(np.int32)
        place = np.repeat(np.cumsum(marked), marked) - np.arange(1, len(text) + 1)
        cell = first[place] + np.repeat(np.arange(len(blocks), dtype=np.int32), marked)  # of each character in text order
        order = np.empty(len(text), np.int32)  # the character of each cell
        order[cell] = np.arange(len(text), dtype=np.int32)
        trie, letter = self.trie, self.trie.letter[text]
        # The edges of the graph, by character in text order: every character, and the words from it.
        go = np.flatnonzero(place).astype(np.int32)
        head, node, edges = np.zeros(len(go), np.int64), np.zeros(len(go), np.int32), []
        for k in range(1, min(self.longest, most) + 1):
            if k > 1:
                on = np.flatnonzero(trie.inner[node])
                go, node, head = go[on], node[on], head[on] if k <= len(trie.heads) else head
            if k <= len(trie.heads):
                head = head * trie.width + letter[go + (k - 1)]
                node = trie.heads[k - 1][head]
            else:
                node = trie.step(node, letter[go + (k - 1)])
            worth = trie.worth[node]
            if k == 1:
                edges.append((go, np.where(np.isneginf(worth), self.unknown, worth)))
            else:
                word = np.flatnonzero(worth > -np.inf)
                edges.append((go[word], worth[word]))
        # A cell's edges stand together, by length.
        count = np.zeros(len(text), np.int32)
        for source, _ in edges:
            count[source] += 1
        count = count[order]
        begins = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        free = begins[cell]
        edge, length, target = np.empty(begins[-1]), np.empty(begins[-1], np.int32), np.empty(begins[-1], np.int32)
        for k, (source, worth) in enumerate(edges, 1):
            at = free[source]
            free[source] = at + 1
            edge[at], length[at], target[at] = worth, k, cell[source + k]
        owner = np.repeat(np.arange(len(text), dtype=np.int32), count)
        total, step = np.zeros(len(text)), np.zeros(len(text), np.int32)
        for p in range(1, most + 1):
            a, b = first[p], first[p + 1]
            x, y = begins[a], begins[b]
            value, own = edge[x:y] + total[target[x:y]], owner[x:y]
            total[a:b] = np.maximum.reduceat(value, begins[a:b] - x)
            # Of equal ones the longest, which comes last.
            same = value == total[own]
            step[own[same]] = length[x:y][same]
        steps, out, start = step[cell].tolist(), [], 0
        for block in blocks:
            way, i, n = [], 0, len(block)
            while i < n:
                j = i + steps[start + i]
                way.append(block[i:j])
                i = j
            out.append(way)
            start += n + 1
        return out

    def chain(self, run: str) -> list[str]:
        """A run cut by the most probable states of its characters."""
        none = (self.unseen,) * 4
        own = self.emit.get(run[0], none)
        score = [self.turn[END, BEGIN] + own[BEGIN], _NEVER, _NEVER, self.turn[END, SINGLE] + own[SINGLE]]
        back = []
        for c in run[1:]:
            own, following, came = self.emit.get(c, none), [], []
            for state in range(4):
                most, before = max((score[b] + self.turn[b, state], b) for b in _BEFORE[state])
                following.append(most + own[state])
                came.append(before)
            score = following
            back.append(came)
        state = max((END, SINGLE), key=lambda s: score[s])
        cuts, at = [len(run)], len(run)
        for came in reversed([None, *back]):
            at -= 1
            if state in (BEGIN, SINGLE):
                cuts.append(at)
            state = came[state] if came else state
        cuts = sorted({0, *cuts})
        return [run[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def parts(self, block: str, way: list[str]) -> list[str]:
        """The words of a block by its best way, runs of characters cut again."""
        if min(map(len, way)) > 1:
            return way
        out: list[str] = []
        held: list[str] = []
        for word in [*way, ""]:
            if len(word) == 1:
                held.append(word)
                continue
            if len(held) > 1 and any(c not in self.words for c in held):
                out += self.chain("".join(held))
            else:
                out += held
            held = []
            if word:
                out.append(word)
        return out

    def whole(self, block: str) -> bool:
        """Whether a block is not cut."""
        return block[0].isdigit() or block in self.words

    def cut(self, text: str) -> Iterator[str]:
        """The words of a text in order; what is no letter or digit parts."""
        for block in _BLOCK.findall(text):
            yield from [block] if self.whole(block) else self.parts(block, self.best(block))

    @cached_property
    def inside(self) -> _Inside:
        return _Inside(self.words)

    def search(self, text: str) -> Iterator[str]:
        """``cut`` with the known words of two and three characters inside a
        longer word before it, and without words of one character."""
        for word in self.cut(text):
            yield from self.inside[word].split()

    def searched(self, texts: list[str]) -> Iterator[str]:
        """``search`` of each text, joined by spaces; some texts at a time, so
        that what is held does not grow with their number."""
        for some in _some(texts, _TOGETHER):
            blocks = [_BLOCK.findall(t) for t in some]
            once = dict.fromkeys(b for of in blocks for b in of)
            ways = [b for b in once if not self.whole(b)]
            once |= {b: self.inside[b] for b in once if self.whole(b)}
            once |= {b: " ".join(filter(None, map(self.inside.__getitem__, self.parts(b, way)))) for b, way in zip(ways, self.best_of(ways), strict=True)}
            for of in blocks:
                yield " ".join(filter(None, map(once.__getitem__, of)))

    def filled(self, column: pd.Series) -> pd.Series:
        """``searched`` with null for null. The rows stay Python strings: an
        array of them would give each the width of the longest."""
        there = column.notna()
        found = self.searched(column[there].tolist())
        return pd.Series([next(found) if t else None for t in there], index=column.index, dtype=object)


def _some(texts: list[str], size: int) -> Iterator[list[str]]:
    """``texts`` in order in lists of about ``size`` characters."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def word_counts(rows: DataFrame, column: str) -> DataFrame:
    """(word, n) over all words of a spaced column. Words are counted within
    some rows of a task first, so few of their repeats reach the shuffle."""
    gap = rf"[^{WORDS.strip('[]+')}]+"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            start = 0
            while start < len(texts):
                # Rows of about 16 MB; one is taken at least.
                n = 1024
                while n > 1 and texts.slice(start, n).nbytes > 1 << 24:
                    n //= 2
                words = pc.list_flatten(pc.split_pattern_regex(texts.slice(start, n), pattern=gap))
                found = pc.value_counts(words.filter(pc.not_equal(words, "")))
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])
                start += n

    some = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).mapInArrow(counted, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n"))


def _least_kept(counts: DataFrame, most: int) -> int:
    """A count that enough words reach, the least such; so that words of less
    need not be ordered. Passes a row for each different count."""
    so_far = 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        so_far += r["words"]
        if so_far >= most:
            return r["n"]
    return 0


def learn(rows: DataFrame, column: str, most_words: int = 200_000, least: int = 2, longest: int = 24) -> Segmenter:
    """A segmenter from a spaced column. The dictionary is its ``most_words``
    most frequent words of ``least`` or more and ``longest`` characters or
    fewer, which bounds what is sent to the tasks; the chain counts all words.
    What passes the driver are these words and four numbers a character."""
    counts = word_counts(rows, column).where(~F.col("word").rlike(r"^\p{N}+$")).persist()
    known = counts.where((F.col("n") >= least) & (F.length("word") <= longest))
    kept = known.where(F.col("n") >= _least_kept(known, most_words)).orderBy(F.desc("n"), "word").limit(most_words).collect()
    size = F.length("word")
    place = F.posexplode(F.split("word", "")).alias("k", "c")
    state = F.when(size == 1, SINGLE).when(F.col("k") == 0, BEGIN).when(F.col("k") == size - 1, END).otherwise(MIDDLE)
    seen = counts.select("n", size.alias("size"), place, "word").where("c <> ''").groupBy("c", state.alias("state")).agg(F.sum("n").alias("n")).collect()
    shape = counts.select(
        *[F.sum(F.when(when, F.col("n") * times).otherwise(0)).alias(name) for name, when, times in (
            ("single", size == 1, 1), ("long", size > 1, 1), ("two", size == 2, 1), ("more", size > 2, 1), ("middles", size > 2, size - 3),
        )]
    ).first()
    counts.unpersist()
    return _model(kept, seen, {k: v or 0 for k, v in shape.asDict().items()})


def _model(kept: list, seen: list, shape: dict) -> Segmenter:
    log = lambda part, whole: math.log(max(part, 0.5) / max(whole, 1))
    total = sum(r["n"] for r in kept)
    of_state = [0] * 4
    for r in seen:
        of_state[r["state"]] += r["n"]
    emit: dict[str, list[float]] = {}
    for r in seen:
        emit.setdefault(r["c"], [log(0, n) for n in of_state])[r["state"]] = log(r["n"], of_state[r["state"]])
    words = shape["single"] + shape["long"]
    turn = {(b, s): log(shape["long"] if s == BEGIN else shape["single"], words) for b in (END, SINGLE) for s in (BEGIN, SINGLE)}
    turn |= {(BEGIN, MIDDLE): log(shape["more"], shape["long"]), (BEGIN, END): log(shape["two"], shape["long"])}
    turn |= {(MIDDLE, MIDDLE): log(shape["middles"], shape["more"] + shape["middles"]), (MIDDLE, END): log(shape["more"], shape["more"] + shape["middles"])}
    return Segmenter({r["word"]: log(r["n"], total) for r in kept}, {c: tuple(x) for c, x in emit.items()}, turn, log(0, total), log(0, max([1, *of_state])))


def segmented(rows: DataFrame, text: Column, model: Segmenter, name: str = "search_tokens") -> DataFrame:
    """``rows`` with the words for searching, joined by spaces; null for null."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return sent.value.filled(column)

    return rows.withColumn(name, run(text))
