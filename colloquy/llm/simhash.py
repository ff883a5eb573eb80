"""SimHash near-duplicates by a self-join of a binary trie.

Equal fingerprints collapse first (map-side combine, so a group of copies that
holds a third of all rows is one row). The trie over the distinct fingerprints
is then joined with itself: pairs of nodes descend together, add up the bits
in which they differ, and go no further once the budget is exceeded. Its top
levels are Spark rows, a key for each pair of nodes within the budget; a pair
of nodes that is too large descends further before it reaches a task. Tasks
emit a spanning forest of the links that they find, never all pairs of a group,
and ``graph.components`` joins the forests.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows repeat; an all-null group of doc_ids has a null
component_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, stash
from .graph import components

#: A-Z to a-z, every other byte to itself.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    """64 bits; one is set where over half of the shingles' hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        block = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``, and ``more`` long columns."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            prints = pa.array([fingerprint(t.as_py()) for t in b.column(1)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), prints, *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return asked.mapInArrow(batches, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in asked.columns[2:])]))


class _Forest:
    """Union-find over positions, fed with arrays of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.label[a], self.label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def trie_links(values: np.ndarray, side: np.ndarray, both: bool, budget: int = 2, leaf: int = 8, block: int = 1 << 17) -> np.ndarray:
    """Labels that join positions of ``values`` (uint64, sorted, distinct)
    whose Hamming distance is at most ``budget``.

    ``both``: the two sides are the two nodes of a pair and only links across
    count; else the node is joined with itself. Blocks of node pairs are taken
    depth first, so memory stays bounded however dense the links are.
    """
    forest = _Forest(len(values))
    if len(values) < 2:
        return forest.label
    if both:
        cut = int(np.searchsorted(side, 1))  # side 0 sorts first
        if cut in (0, len(values)):
            return forest.label
        root = (np.array([0]), np.array([cut]), np.array([cut]), np.array([len(values)]))
    else:
        root = (np.array([0]), np.array([len(values)]), np.array([0]), np.array([len(values)]))
    depth0 = 0
    stack = [(depth0, *root)]
    while stack:
        depth, al, ah, bl, bh = stack.pop()
        small = (ah - al) * (bh - bl) <= leaf
        if depth == 64:
            small[:] = True
        if small.any():
            wide, count = bh[small] - bl[small], (ah[small] - al[small]) * (bh[small] - bl[small])
            of = np.repeat(np.arange(len(count)), count)
            k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            a, b = al[small][of] + k // wide[of], bl[small][of] + k % wide[of]
            near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            forest.add(a[near], b[near])
        al, ah, bl, bh = al[~small], ah[~small], bl[~small], bh[~small]
        if not len(al):
            continue
        shift = np.uint64(63 - depth)
        one = np.uint64(1)

        def middle(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            start = ((values[lo] >> shift) | one) << shift
            at = np.where(both & (lo >= cut), cut + np.searchsorted(values[cut:], start), np.searchsorted(values[:cut], start)) if both else np.searchsorted(values, start)
            return np.clip(at, lo, hi)

        am, bm = middle(al, ah), middle(bl, bh)
        same = (al == bl) & (ah == bh)
        halves = [(al, am, bl, bm, al >= 0), (am, ah, bm, bh, al >= 0), (al, am, bm, bh, al >= 0), (am, ah, bl, bm, ~same)]
        parts = [[x[ok & (lo < hi) & (lo2 < hi2)] for x in (lo, hi, lo2, hi2)] for lo, hi, lo2, hi2, ok in halves]
        al, ah, bl, bh = (np.concatenate([p[i] for p in parts]) for i in range(4))
        # The bits in which the two prefixes differ so far; over budget: pruned.
        keep_from = np.uint64(63 - depth)
        differ = np.bitwise_count((values[al] ^ values[bl]) >> keep_from) <= budget
        al, ah, bl, bh = al[differ], ah[differ], bl[differ], bh[differ]
        for at in range(0, len(al), block):
            stack.append((depth + 1, *(x[at : at + block] for x in (al, ah, bl, bh))))
    return forest.label


def _node_join(budget: int):
    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mask = int(key[1])
        values = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        side = rows["side"].to_numpy()
        order = np.lexsort((values, side))
        values, side = values[order], side[order]
        label = trie_links(values, side, mask != 0, budget)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": values[moved].view(np.int64), "v": values[label[moved]].view(np.int64)})

    return join


def _masks(bits: int, budget: int) -> list[int]:
    out = [0]
    if budget >= 1:
        out += [1 << i for i in range(bits)]
    if budget >= 2:
        out += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return out


def _depth(n: int, parts: int, node_rows: int, least_rows: int) -> int:
    """Levels that are Spark rows: nodes of ``node_rows`` at most, and enough
    pairs for all partitions while nodes hold ``least_rows``. Each level more
    adds copies of every fingerprint, so there are no more than that."""
    for_size = (max(n, 1) // node_rows).bit_length()
    for_parts = next(d for d in range(64) if (1 << d) * (1 + d + d * (d - 1) // 2) >= 2 * parts)
    return min(32, max(for_size, min(for_parts, (max(n, 1) // least_rows).bit_length())))


def near_links(prints: DataFrame, budget: int = 2, node_rows: int = 1 << 20, least_rows: int = 1 << 12) -> DataFrame:
    """(u, v): a spanning forest, task by task, of all links within ``budget``
    bits among the distinct ``fp`` of ``prints``."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = _depth(prints.count(), parts, node_rows, min(least_rows, node_rows))

    def descend(rows: DataFrame, done: int, more: int) -> DataFrame:
        """Take (fp, node, mask, side) from depth ``done`` to ``done + more``."""
        masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(more, budget)])).alias("step")
        here = F.expr(f"shiftrightunsigned(fp, {64 - done - more}) & {(1 << more) - 1}L") if more else F.lit(0).cast("long")
        spread = rows.select("*", masks).select("*", here.alias("here"))
        if budget < 64:
            spread = spread.where(F.bit_count("mask") + F.bit_count("step") <= budget)
        other = F.col("here").bitwiseXOR(F.col("step"))
        # A pair of different nodes is named by its side 0; below it, side 1
        # takes the partner's name, so that both sides meet under one key.
        name = F.when(F.col("mask") == 0, F.least("here", other)).otherwise(F.when(F.col("side") == 0, F.col("here")).otherwise(other))
        side = F.when(F.col("mask") == 0, (F.col("here") > other).cast("int")).otherwise(F.col("side"))
        return spread.select(
            "fp",
            (F.shiftleft("node", more) + name).alias("node"),
            (F.shiftleft("mask", more) + F.col("step")).alias("mask"),
            side.alias("side"),
            F.lit(done + more).alias("depth"),
        )

    start = prints.select("fp", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("mask"), F.lit(0).alias("side"))
    pairs = descend(start, 0, depth)
    found = []
    while True:
        # Node pairs that are too large for one task descend four more levels.
        sizes = pairs.groupBy("node", "mask").count().where(F.col("count") > 2 * node_rows).select("node", "mask")
        if depth + 4 > 60 or sizes.isEmpty():
            found.append(pairs)
            break
        found.append(pairs.join(sizes, ["node", "mask"], "left_anti"))
        pairs = descend(pairs.join(sizes, ["node", "mask"], "left_semi").select("fp", "node", "mask", "side"), depth, 4)
        depth += 4
    links = None
    for f in found:
        part = f.select("node", "mask", "side", "fp").groupBy("node", "mask").applyInPandas(_node_join(budget), "u long, v long")
        links = part if links is None else links.unionByName(part)
    return links


def _components(prints: DataFrame, budget: int) -> DataFrame:
    """(fp, root, component_id) of the distinct ``fp`` of ``prints``."""
    distinct, _ = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links, path = stash(near_links(distinct.select("fp"), budget))
    roots = components(links)
    discard(prints.sparkSession, path)
    labelled = distinct.join(roots, distinct.fp == roots.id, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return stash(labelled.join(named, "root").select("fp", "root", "component_id"))[0]


def near_duplicates(docs: DataFrame, budget: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest
    doc_id reachable over links of at most ``budget`` differing bits."""
    prints, _ = stash(fingerprints(docs))
    return prints.join(_components(prints, budget).drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = 2) -> DataFrame:
    """One document of each component: the one of the smallest doc_id, and of
    those that share it, or have none, the one of the least text hash. Rows
    equal to it in doc_id and text stay with it, but without a doc_id one stays.
    A doc_id that repeats with texts of several components stays in each."""
    text_hash = free_name(docs, "text_hash")
    prints, _ = stash(fingerprints(docs, F.xxhash64("text").alias("print_hash")))
    place = F.struct(F.col("doc_id").isNull().alias("nowhere"), F.col("doc_id").alias("kept_id"), F.col("print_hash").alias("kept_hash"))
    first = prints.join(_components(prints, budget).select("fp", "root"), "fp").groupBy("root").agg(F.min(place).alias("first")).select("first.*")
    same = docs["doc_id"].cast("long").eqNullSafe(first["kept_id"]) & (F.xxhash64(docs["text"]) == first["kept_hash"])
    kept = docs.join(first, same, "left_semi")
    nameless = kept.where(F.col("doc_id").isNull()).withColumn(text_hash, F.xxhash64("text")).dropDuplicates([text_hash]).drop(text_hash)
    return kept.where(F.col("doc_id").isNotNull()).unionByName(nameless)
