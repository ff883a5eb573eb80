"""Benchmark decontamination under edit distance.

A document holds an item if some stretch of its words is within ``1 - likeness``
times the item's words of the item, in word edits. Every place of every text
begins a window of the item's size. CGK embedding walks a window: at each step
it writes the word that it stands on, and a random bit of (step, word) says
whether to go on to the next; stretches at a small edit distance so become
sequences at a small Hamming distance. Bit-sampling LSH looks up a few sampled
steps at a time in a table of the items' walks. A repetition has coins and
steps of its own; repetitions are added until randomly edited items, with as
many edits as are allowed, are found with the wanted recall, and fresh ones,
which had no say in the number, are too. A group of sizes for which
``most`` repetitions do not suffice takes every window that may hold an item
instead. What collides is verified by exact edit distance against the text
around the window; nothing else leads to a verification.

An item of over ``PIECE`` words is looked up by its pieces of about half of
that and more. If a stretch is within a share of the item's words in edits, one piece at
least is within the same share of its own, as the edits add up; where a piece
is found, the whole item is verified. So tables, walks and windows have a
bounded size however long an item is.

Two counts leave out windows that cannot hold an item, and lose nothing: where
a stretch within k edits of an item of n words begins, all but k of the next n
words are words of items, so other places are not walked; and a collision with
too few of its own item's words around it is not verified.

Items of like sizes (within a factor of 1.4) share sampled steps, all below 1.5
times the least size, where most walks are still inside the item. A walk from
place p at step t only depends on (p, t), so keys of all windows come from one
backward pass over the steps on whole arrays, a block of places at a time.

The items are the query set: each text once, broadcast in blocks of about
``block_items``, each against all rows, so neither the broadcast nor a task
grows with either table. A row needs only its own text: no shuffle of
documents, and a hot source or a group of copies is only rows.

Defined results: null text or item is empty; an empty item matches nothing, an
item of under five words only exactly; null doc_ids are carried through;
repeated rows repeat; repeated items count as items; extra columns are ignored;
an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"\w+")
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
_SLOT = 4  # steps out of which one is sampled
_SEED = 5
#: Words of the longest item that is looked up as a whole.
PIECE = 192


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def coins(turn: int, part: int, word: np.ndarray) -> np.ndarray:
    """uint32: the fair bits of (repetition, step, word) for the 32 steps from
    ``32 * part`` on."""
    x = word.astype(np.uint32) * _ODD[0] + np.uint32((turn * 0x51ED270B + part * 0x2545F491 + _SEED) & 0xFFFFFFFF)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x21F0AAAD)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x735A2D97)
    return x ^ (x >> np.uint32(15))


def sampled_steps(least: int, turn: int, bits: int) -> list[int]:
    """Ascending steps of a repetition, one of each of ``bits`` slots in a row
    that begin anywhere below 1.5 times the least size."""
    span = max(1, 3 * least // 2)
    draw = np.random.default_rng([_SEED, turn, least])
    stretch = min(span, _SLOT * bits)
    begin = int(draw.integers(0, span - stretch + 1))
    return [begin + int((i + draw.random()) * stretch / bits) for i in range(bits)]


def _with(keys: np.ndarray, word: np.ndarray, nth: int) -> np.ndarray:
    return (keys ^ (word.astype(np.uint32) * _ODD[0])) * _ODD[1 + nth % 3]


def walk(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, turn: int, steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, valid) of the windows ``flat[start:end]``, one step at a time;
    not valid where a sampled step lies past a window's end."""
    at, seen, valid = starts.copy(), [], np.ones(len(starts), dtype=bool)
    for t in range(steps[-1] + 1):
        inside = at < ends
        word = np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0)
        for s in steps:
            if s == t:
                seen.append(word)
                valid &= inside
        at = at + ((coins(turn, t >> 5, word) >> np.uint32(t & 31)) & 1)
    keys = np.zeros(len(starts), dtype=np.uint32)
    for nth in range(len(steps) - 1, -1, -1):
        keys = _with(keys, seen[nth], nth)
    return keys, valid


def walk_all(coded: np.ndarray, turn: int, steps: list[int]) -> np.ndarray:
    """``walk`` from every place of ``coded`` but the last ``steps[-1]``."""
    thrown = [coins(turn, k, coded) for k in range((steps[-1] >> 5) + 1)]
    last, nth, n = steps[-1], len(steps) - 1, len(coded)
    keys, other, go = np.zeros(n, dtype=np.uint32), np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for t in range(last, -1, -1):
        if t < last:
            n -= 1
            np.right_shift(thrown[t >> 5][:n], np.uint32(t & 31), out=go[:n])
            np.bitwise_and(go[:n], np.uint32(1), out=go[:n])
            np.bitwise_xor(keys[1 : n + 1], keys[:n], out=other[:n])
            np.multiply(other[:n], go[:n], out=other[:n])
            np.bitwise_xor(other[:n], keys[:n], out=other[:n])
            keys, other = other, keys
        while nth >= 0 and steps[nth] == t:
            keys[:n] = _with(keys[:n], coded[:n], nth)
            nth -= 1
    return keys[:n]


def distance_within(item: list, text: list, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of ``text`` nearest to ``item``, the
    earliest of equals; None if it takes more than ``most`` edits."""
    n = len(text)
    row, begin = [0] * (n + 1), list(range(n + 1))
    for i, w in enumerate(item, 1):
        old, old_begin = row, begin
        row, begin = [i] + [0] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            best, source = old[j - 1] + (w != text[j - 1]), old_begin[j - 1]
            if old[j] + 1 < best:
                best, source = old[j] + 1, old_begin[j]
            if row[j - 1] + 1 < best:
                best, source = row[j - 1] + 1, begin[j - 1]
            row[j], begin[j] = best, source
        if min(row) > most:
            return None
    end = min(range(n + 1), key=lambda j: (row[j], j))
    return (row[end], begin[end], end) if row[end] <= most else None


def _last_row(item: np.ndarray, text: np.ndarray, anywhere: bool) -> np.ndarray:
    """The edits between all of ``item`` and the stretch up to each place of
    ``text`` that begins ``anywhere``, else at its start. A row is an array:
    running minima take care of words that the text has more."""
    n = len(text)
    step = np.arange(n + 1)
    row = np.zeros(n + 1, dtype=np.int64) if anywhere else step
    for i, w in enumerate(item, 1):
        new = np.empty(n + 1, dtype=np.int64)
        new[0] = i
        np.minimum(row[:-1] + (text != w), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    return row


def long_distance_within(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """``distance_within`` for long items; of equals the earliest end, then the
    earliest start."""
    row = _last_row(item, text, True)
    end = int(row.argmin())
    if row[end] > most:
        return None
    back = _last_row(item[::-1], text[:end][::-1], False)
    return int(row[end]), end - int(np.flatnonzero(back == row[end])[-1]), end


def _edited(item: np.ndarray, edits: int, draw: np.random.Generator) -> list[int]:
    """``item`` after random word edits; 0 is a word that no item has."""
    out = item.tolist()
    for _ in range(edits):
        at, kind = int(draw.integers(0, max(len(out), 1))), draw.integers(0, 3)
        if kind == 0 and out:
            out[at] = 0
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, 0)
    return out


@dataclass
class Sizes:
    """Pieces of like sizes with the LSH table of each of their repetitions."""

    sizes: list[tuple[int, int]]  # each with its allowed edits
    members: np.ndarray
    tables: list[tuple[list[int], np.ndarray, np.ndarray]]  # steps, sorted keys, their pieces
    recall: float
    every: bool = False  # all windows are looked at, as the tables find too few

    @property
    def least(self) -> int:
        return self.sizes[0][0]

    @property
    def slack(self) -> int:
        return max(k for _, k in self.sizes)


@dataclass
class Index:
    """A block of items, ready to broadcast; ``pieces`` are what the tables
    hold: short items as they are, parts of long ones."""

    ids: list
    items: list[np.ndarray]
    allowed: list[int]
    pieces: list[np.ndarray]
    spare: list[int]  # the edits that a piece may take
    whole: list[tuple[int, int]]  # the item of a piece, and where in it the piece begins
    number: dict[str, int]
    groups: list[Sizes]
    flags: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"flags": {}}

    def present(self, group: int, turn: int) -> np.ndarray:
        """Flags of the low 18 bits of a table's keys."""
        if (group, turn) not in self.flags:
            flags = np.zeros(1 << 18, dtype=bool)
            flags[self.groups[group].tables[turn][1] & 0x3FFFF] = True
            self.flags[group, turn] = flags
        return self.flags[group, turn]


class _Copies:
    """Randomly edited copies of a group's members, each in a window."""

    def __init__(self, items: list[np.ndarray], allowed: list[int], members: np.ndarray, draw: np.random.Generator, tries: int):
        least, widest = min(len(items[i]) for i in members), max(len(items[i]) for i in members)
        self.slack = max(allowed[i] for i in members)
        room = 3 * least // 2 + self.slack + 8
        self.width = room + widest + 2 * self.slack
        of, parts = [], []
        for k in range(tries):
            m = int(draw.integers(0, len(members))) if k >= len(members) else k
            made = _edited(items[members[m]], allowed[members[m]], draw)
            of.append(m)
            parts.append(([0] * self.slack + made + [0] * self.width)[: self.width])
        self.of, self.flat = np.array(of), np.array(parts, dtype=np.int64).ravel()
        self.found = np.zeros(tries, dtype=bool)

    def look(self, turn: int, steps: list[int], keys: np.ndarray, valid: np.ndarray) -> None:
        windows = walk_all(self.flat, turn, steps)
        windows = np.append(windows, np.zeros(len(self.flat) - len(windows), dtype=np.uint32)).reshape(len(self.of), self.width)
        self.found |= (windows[:, : 2 * self.slack + 1] == keys[self.of][:, None]).any(axis=1) & valid[self.of]


def fitted(items: list[np.ndarray], allowed: list[int], members: np.ndarray, bits: int, recall: float, most: int = 1024, tries: int = 256) -> Sizes:
    """The tables of one group of sizes: repetitions are added until edited
    copies of its items collide with them with ``recall``, and fresh copies,
    which had no say in the number, do as well."""
    least = min(len(items[i]) for i in members)
    draw = np.random.default_rng([_SEED, least])
    copies = [_Copies(items, allowed, members, draw, tries)]
    flat = np.concatenate([items[i] for i in members])
    ends = np.cumsum([len(items[i]) for i in members])
    starts = ends - np.array([len(items[i]) for i in members])
    tables, walks = [], []
    sizes = sorted({(len(items[i]), allowed[i]) for i in members})
    while True:
        if np.concatenate([c.found for c in copies]).mean() >= recall:
            fresh = _Copies(items, allowed, members, draw, tries)
            for turn, w in enumerate(walks):
                fresh.look(turn, *w)
            if fresh.found.mean() >= recall:
                return Sizes(sizes, members, tables, float(fresh.found.mean()))
            copies.append(fresh)
        if len(tables) == most:
            return Sizes(sizes, members, [], 1.0, True)
        turn = len(tables)
        steps = sampled_steps(least, turn, bits)
        keys, valid = walk(flat, starts, ends, turn, steps)
        walks.append((steps, keys, valid))
        for c in copies:
            c.look(turn, steps, keys, valid)
        order = np.argsort(keys[valid], kind="stable")
        tables.append((steps, keys[valid][order], members[valid][order]))


def build(rows: list[tuple], likeness: float = 0.8, bits: int = 3, recall: float = 0.98, most: int = 1024) -> Index:
    number: dict[str, int] = {}
    ids, items, allowed, pieces, spare, whole = [], [], [], [], [], []
    edits = lambda n: int((1 - likeness) * n + 1e-9)
    for item_id, text in rows:
        if w := words(text):
            n = len(w)
            own = np.array([number.setdefault(x, len(number) + 1) for x in w], dtype=np.int64)
            cuts = np.linspace(0, n, -(-2 * n // PIECE) + 1 if n > PIECE else 2).astype(np.int64)
            for lo, hi in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                pieces.append(own[lo:hi])
                spare.append(edits(hi - lo))
                whole.append((len(items), lo))
            ids.append(item_id)
            items.append(own)
            allowed.append(edits(n))
    lengths, groups = np.array([len(x) for x in pieces], dtype=np.int64), []
    left = np.unique(lengths)
    while len(left):
        like = left[left <= 1.4 * left[0]]
        groups.append(fitted(pieces, spare, np.flatnonzero(np.isin(lengths, like)), bits, recall, most))
        left = left[len(like) :]
    return Index(ids, items, allowed, pieces, spare, whole, number, groups)


def _walked(group: Sizes, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, begin): the places of windows that may hold an item, with the
    words that their walks can reach, and which of them begin such a window."""
    k, size = group.slack, len(coded) + 1
    known, may = np.append(0, np.cumsum(coded > 0)), np.zeros(len(coded) + 1, dtype=bool)
    for n, edits in group.sizes:
        may[: max(size - n, 0)] |= known[n:] - known[:-n] >= n - edits
    at = np.flatnonzero(may)
    first, last = np.maximum(at - k, 0), np.minimum(at + k + 1, size - 1)
    opened = np.bincount(first, minlength=size)
    begin = np.cumsum(opened - np.bincount(last, minlength=size))[:-1] > 0
    reach = np.cumsum(opened - np.bincount(np.minimum(last + 3 * group.least // 2, size - 1), minlength=size))[:-1] > 0
    places = np.flatnonzero(reach)
    return places, begin[places]


def candidates(index: Index, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, item) where a window's walk and an item's collide."""
    place, item = [], []
    for g, group in enumerate(index.groups):
        places, begin = _walked(group, coded)
        part = coded[places]
        if group.every:
            for i in group.members:
                place.append(places[begin])
                item.append(np.full(begin.sum(), i))
        for turn, (steps, keys, members) in enumerate(group.tables):
            if len(part) <= steps[-1] or not len(keys):
                continue
            got = walk_all(part, turn, steps)
            hit = index.present(g, turn).take(got & np.uint32(0x3FFFF), mode="clip")
            at = np.flatnonzero(hit & begin[: len(got)])
            low, high = np.searchsorted(keys, got[at], "left"), np.searchsorted(keys, got[at], "right")
            count = high - low
            of = np.repeat(np.arange(len(at)), count)
            place.append(places[at[of]])
            item.append(members[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(of))])
    both = np.unique(np.column_stack([np.concatenate(item), np.concatenate(place)]), axis=0) if place else np.zeros((0, 2), dtype=np.int64)
    return both[:, 1], both[:, 0]


def _rich(index: Index, coded: np.ndarray, place: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether the words around a place are enough of the item's, sorted by item."""
    ok, marked = np.zeros(len(place), dtype=bool), np.zeros(len(index.number) + 1, dtype=bool)
    for i, first in zip(*np.unique(item, return_index=True), strict=True):
        last = int(np.searchsorted(item, i, "right"))
        w, k = index.pieces[i], index.spare[i]
        marked[w] = True
        span = np.arange(-2 * k, len(w) + 2 * k)
        for at in range(int(first), last, 4096):
            near = place[at : min(at + 4096, last), None] + span
            ok[at : at + len(near)] = marked[coded[np.clip(near, 0, len(coded) - 1)]].sum(axis=1) >= len(w) - k
        marked[w] = False
    return ok


def search(index: Index, texts: list[str], block: int = 1 << 16) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) by word positions: an item's nearest
    stretch in each text, if it is within the item's allowed edits."""
    number, slack = index.number, max(index.spare, default=0)
    tokens = [[number.get(w, 0) for w in words(t)] for t in texts]
    room = max((max(3 * g.least // 2, g.sizes[-1][0]) + 2 * g.slack for g in index.groups), default=0)
    first, flat = [], []
    for w in tokens:
        flat += [0] * slack  # windows may begin before the text
        first.append(len(flat))
        flat += w
    coded = np.array(flat + [0] * (room + 1), dtype=np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    known: dict[tuple, tuple | None] = {}
    done = set()
    for begin in range(0, len(flat), block):
        part = coded[begin : begin + block + room]
        place, item = candidates(index, part)
        inside = place < block
        place, item = place[inside] + begin, item[inside]
        ok = _rich(index, coded, place, item)
        place, item = place[ok], item[ok]
        owner = np.maximum(np.searchsorted(first, place + slack, side="right") - 1, 0)
        # One verification serves windows that begin within the slack of it.
        for o, i, s in zip(owner.tolist(), item.tolist(), place.tolist(), strict=True):
            k, n, text = index.spare[i], len(index.pieces[i]), tokens[o]
            region = (s - first[o]) // (k + 1)
            if (o, i, region) in done:
                continue
            done.add((o, i, region))
            lo, hi = max(0, region * (k + 1) - 2 * k), min(len(text), (region + 1) * (k + 1) + n + 2 * k)
            key = (i, *text[lo:hi])
            if key not in known:  # passages repeat
                known[key] = distance_within(index.pieces[i].tolist(), text[lo:hi], k)
            if got := known[key]:
                answer, (of, begins) = (got[0], lo + got[1], lo + got[2]), index.whole[i]
                if n < len(index.items[of]):
                    answer = _verified(index, of, text, answer[1] - begins, done, o)
                if answer and ((o, of) not in best or answer < best[(o, of)]):
                    best[(o, of)] = answer
    return [(o, i, *answer) for (o, i), answer in sorted(best.items())]


def _verified(index: Index, item: int, text: list[int], start: int, done: set, owner: int) -> tuple[int, int, int] | None:
    """A long item that may begin around ``start``, once for each stretch of
    its slack."""
    k, n = index.allowed[item], len(index.items[item])
    region = start // (k + 1)
    if (owner, "item", item, region) in done:
        return None
    done.add((owner, "item", item, region))
    lo, hi = max(0, region * (k + 1) - 2 * k), max(0, min(len(text), (region + 1) * (k + 1) + n + 2 * k))
    got = long_distance_within(index.items[item], np.array(text[lo:hi], dtype=np.int64), k)
    return got and (got[0], lo + got[1], lo + got[2])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("item")).withColumn("item_key", F.md5("item"))


def _indexes(docs: DataFrame, benchmark: DataFrame, likeness: float, recall: float, block_items: int) -> Iterator:
    """Blocks of the item texts, broadcast one after the other."""
    items = _items(benchmark).groupBy("item_key").agg(F.first("item").alias("item"))
    blocks = max(1, -(-items.count() // block_items))
    for block in range(blocks):
        part = items.where(F.expr(f"pmod(xxhash64(item_key), {blocks}) = {block}")) if blocks > 1 else items
        rows = sorted((r["item_key"], r["item"]) for r in part.collect())
        yield docs.sparkSession.sparkContext.broadcast(build(rows, likeness, recall=recall))


def _found(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """``search`` over a column, about a million characters at a time."""
    held, at, chars = [], 0, 0
    for i in range(len(texts)):
        held.append(texts[i].as_py() or "")
        chars += len(held[-1])
        if chars >= 1_000_000 or i + 1 == len(texts):
            for o, *rest in search(index, held):
                yield (at + o, *rest)
            held, at, chars = [], i + 1, 0


def contaminated(docs: DataFrame, benchmark: DataFrame, likeness: float = 0.8, recall: float = 0.98, block_items: int = 20000) -> DataFrame:
    """(doc_id, item_id, edits, start_word, end_word): a row for each item
    that a document holds."""
    asked, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for index in _indexes(docs, benchmark, likeness, recall, block_items):

        def batches(it: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            for b in it:
                rows = [(b.column(0)[o].as_py(), index.value.ids[k], e, s, t) for o, k, e, s, t in _found(index.value, b.column(1))]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["doc_id", "item_key", "edits", "start_word", "end_word"])

        found = asked.mapInArrow(batches, "doc_id long, item_key string, edits long, start_word long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out.join(_items(benchmark).select("item_id", "item_key"), "item_key").select("doc_id", "item_id", "edits", "start_word", "end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame, likeness: float = 0.8, recall: float = 0.98, block_items: int = 20000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item. Each row
    is judged by its own text where it is read; nothing is shuffled."""
    at = docs.columns.index("text")
    for index in _indexes(docs, benchmark, likeness, recall, block_items):

        def batches(it: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in it:
                bad = {o for o, *_ in _found(index.value, b.column(at))}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b

        docs = docs.mapInArrow(batches, docs.schema)
    return docs
