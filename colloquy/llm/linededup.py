"""Fuzzy line dedup: one line is kept of each component of similar lines.

Lines are named by XXH64 of their bytes, so exact repeats collapse where they
are read and a line that fills the corpus is a row a task. A line's signature
is one-permutation MinHash over its character shingles: a bin keeps the least
hash that falls into it, and an empty bin borrows from a bin that a fixed
table names. Twelve bands of four bins find a pair at Jaccard 0.8 with
probability 0.998, and at 0.85 with 0.9998.

Lines that share a band meet in one task. Byte sketches of the bins rule out
most pairs; exact Jaccard over the shingle sets decides the rest. A pair is
compared in the first band whose whole key both lines hold, and skipped once
the task has joined its two lines, so a group of near copies costs about as
many comparisons as it has lines, and tasks emit a forest; distributed
union-find joins the forests.

A band of more than ``block_rows`` lines is cut into blocks, each with the
same few representatives of the band, through which a group that fills the band
joins up. A second pass brings the lines that are not of the band's most
frequent component, the rest, to every block. So a band of N lines with a rest
of M costs about N + N * M / block_rows rows, and each pair of different
components is still compared. No link that a band offers is lost, but for pairs
that the byte sketches rule out wrongly (3e-6 at Jaccard 0.8).

Defined results: null and empty texts have no lines; a line without a word is
never dropped; the kept line is the first by (doc_id, line number), a null
doc_id last, and of rows that share a doc_id, or have none, the one of the least
text hash; rows equal in both doc_id and text count as one document, so what
stays of one stays of all; lines of under ``width`` characters are one
shingle, so only equal ones match; extra columns are ignored or carried
through; an empty table gives an empty result. Two different lines share a
name with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, stash
from .graph import components

WIDTH, BANDS, ROWS, LIKENESS = 8, 12, 4, 0.8
_BINS = BANDS * ROWS
_AGREE = 26
_NONE = np.uint64(1 << 32)
_ODD = np.random.default_rng(7).integers(1, 1 << 63, size=8, dtype=np.uint64) | np.uint64(1)
_BORROW = np.random.default_rng(11).integers(0, _BINS, size=(4096, _BINS))


def _named(line: str) -> int:
    """What Spark's xxhash64 gives for the line."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD[5]
    return x ^ (x >> np.uint64(32))


def signatures(lines: list[str], width: int = WIDTH) -> np.ndarray:
    """(lines, bins) uint64: the least shingle hash of each bin."""
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    padded = [x if len(x) >= width else x + "\0" * (width - len(x)) for x in lines]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.maximum(lengths, width) - width + 1
    # Three doublings hash eight characters; the last step also takes widths between.
    h, span = points, 1
    for k in range(3):
        h = h[: len(points) - 2 * span + 1] * _ODD[k] + h[span : len(points) - span + 1]
        span *= 2
    h = _mix(h)
    ends = np.cumsum(np.maximum(lengths, width))
    first = ends - np.maximum(lengths, width)
    line = np.repeat(np.arange(len(lines)), starts)
    at = np.arange(len(line)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(first, starts)
    low = h[at] & np.uint64(0xFFFFFFFF)
    bins = (low * np.uint64(_BINS)) >> np.uint64(32)
    flat = np.full(len(lines) * _BINS, _NONE, dtype=np.uint64)
    np.minimum.at(flat, line * _BINS + bins.astype(np.int64), low)
    empty = np.flatnonzero(flat == _NONE)
    base, slot = empty - empty % _BINS, empty % _BINS
    full = flat.copy()
    for k in range(len(_BORROW)):
        if not len(empty):
            break
        got = flat[base + _BORROW[k][slot]]
        hit = got != _NONE
        full[empty[hit]] = got[hit]
        empty, base, slot = empty[~hit], base[~hit], slot[~hit]
    return full.reshape(len(lines), _BINS)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    sig = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _ODD[6], (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = _mix((key + sig[:, :, r]) * _ODD[3 if r % 2 else 4])
    # The low bits name the band.
    return ((key & ~np.uint64(15)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def band_keys(lines: list[str], width: int = WIDTH) -> np.ndarray:
    """(lines, BANDS) int64: equal entries in a column are candidates."""
    return _band_keys(signatures(lines, width))


def sketches(lines: list[str]) -> list[bytes]:
    """A byte of each bin, then the band keys. Lines of Jaccard 0.8 agree in
    fewer than ``_AGREE`` of the bytes with probability 3e-6, so pairs that do
    are not verified; the keys tell in which bands two lines meet."""
    if not lines:
        return []
    sig = signatures(lines)
    both = np.hstack([_mix(sig).astype(np.uint8), _band_keys(sig).view(np.uint8).reshape(len(lines), 8 * BANDS)])
    return [row.tobytes() for row in both]


def _unpacked(made: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the bins, band keys) of ``sketches``."""
    both = np.frombuffer(b"".join(made), dtype=np.uint8).reshape(-1, _BINS + 8 * BANDS)
    return both[:, :_BINS].copy(), both[:, _BINS:].copy().view(np.int64)


def shingles(line: str, width: int = WIDTH) -> set[str]:
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def similar(a: set[str], b: set[str], likeness: float = LIKENESS) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < likeness * len(large):
        return False
    both = len(small & large)
    return both >= likeness * (len(a) + len(b) - both)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lines array<long>, fresh array<long>, bands
    array<long>): a row for each document; ``text_hash`` is Spark's xxhash64 of
    the text, ``lines`` names its lines in order, 0 where a line has no word. ``fresh`` are names that this task meets first, with
    BANDS entries of ``bands`` each."""

    def flush(texts: list, seen: set) -> tuple[list, list, list]:
        names, fresh_of, new_lines = [], [], []
        for t in texts:
            own, fresh = [], []
            for x in t.split("\n") if t else ():
                if not x.strip(" \t\x0b\x0c\r"):
                    own.append(0)
                    continue
                n = _named(x)
                own.append(n)
                if n not in seen:
                    seen.add(n)
                    fresh.append(n)
                    new_lines.append(x)
            names.append(own)
            fresh_of.append(fresh)
        keys = band_keys(new_lines) if new_lines else np.zeros((0, BANDS), dtype=np.int64)
        bands, at = [], 0
        for fresh in fresh_of:
            bands.append(keys[at : at + len(fresh)].ravel())
            at += len(fresh)
        return names, fresh_of, bands

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        longs = pa.list_(pa.int64())
        for b in it:
            ids, marks, texts = b.column(0), b.column(1), b.column(2)
            start, chars = 0, 0
            for i in range(len(texts)):
                chars += len(texts[i].as_py() or "") if texts[i].is_valid else 0
                if chars < 1_000_000 and i + 1 < len(texts):
                    continue
                names, fresh, bands = flush(texts.slice(start, i + 1 - start).to_pylist(), seen)
                part = slice(start, i + 1)
                yield pa.RecordBatch.from_arrays([ids[part], marks[part], pa.array(names, longs), pa.array(fresh, longs), pa.array(bands, longs)], names=["doc_id", "text_hash", "lines", "fresh", "bands"])
                start, chars = i + 1, 0
                if len(seen) > 2_000_000:  # only spares work; names may repeat
                    seen.clear()

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return asked.mapInArrow(batches, "doc_id long, text_hash long, lines array<long>, fresh array<long>, bands array<long>")


def _members(lines: DataFrame) -> tuple[DataFrame, str]:
    """A stash of (band, id): the different lines of every band that holds two or more.
    Bands are found by an aggregation that combines map-side; a bitmap of their
    names then spares the shuffle of most lines that are in no such band."""
    spark = lines.sparkSession
    each = lines.select("fresh", F.posexplode("bands").alias("i", "band")).select("band", F.expr(f"fresh[i div {BANDS}]").alias("id"))
    shared = each.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("band")
    shared, path = stash(shared)
    bits = spark.sparkContext.broadcast(_bitmap(shared.select(F.col("band").alias("id"))))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bits.value
        for b in it:
            names, bands = b.column(0).flatten().to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False)
            slot = bands & ((len(bitmap) << 6) - 1)
            hit = np.flatnonzero(bitmap[slot >> 6] >> (slot & 63) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(bands[hit]), pa.array(names[hit // BANDS])], names=["band", "id"])

    likely = lines.select("fresh", "bands").mapInArrow(batches, "band long, id long")
    members, members_path = stash(likely.join(shared, "band", "left_semi").distinct())
    discard(spark, path)
    return members, members_path


class _Bucket:
    """Lines of one band, or of a block of a large one, joined by exact
    Jaccard. A pair is compared in the first band that both lines share, and
    not at all once it is joined. ``across``: only pairs of a guest and a host
    count, and ``label`` tells what is joined from the start."""

    def __init__(self, band: int, name: np.ndarray, guest: np.ndarray, label: np.ndarray, sketch: np.ndarray, keys: np.ndarray, line: pa.ChunkedArray, across: bool):
        order = np.lexsort((name, ~guest))
        self.name, self.guest, self.across, self.sketch, self.keys = name[order], guest[order], across, sketch[order], keys[order]
        self.label = np.unique(label[order], return_inverse=True)[1]
        self.order, self.line = order.tolist(), line
        self.sets: dict[int, set[str]] = {}
        self.band = band & 15

    def _set(self, i: int) -> set[str]:
        if i not in self.sets:
            self.sets[i] = shingles(self.line[self.order[i]].as_py())
        return self.sets[i]

    def links(self) -> tuple[list[int], list[int]]:
        label, u, v = self.label, [], []
        guests = int(self.guest.sum())
        for i in range(guests if self.across else len(self.name) - 1):
            begin = guests if self.across else i + 1
            far = begin + np.flatnonzero(label[begin:] != label[i])
            if not len(far):
                continue
            far = far[(self.sketch[far] == self.sketch[i]).sum(axis=1) >= _AGREE]
            far = far[(self.keys[far] == self.keys[i]).argmax(axis=1) == self.band]
            for j in far.tolist():
                if label[j] != label[i] and similar(self._set(i), self._set(j)):
                    label[label == label[j]] = label[i]
                    u.append(int(self.name[i]))
                    v.append(int(self.name[j]))
            self.sets.pop(i, None)
        return u, v


def _keys(rows: pa.Table) -> np.ndarray:
    return np.column_stack([rows.column(i).to_numpy() for i in range(3)])


def _joined(rows: pa.Table, key: np.ndarray) -> pa.RecordBatch:
    """Links of whole buckets in a row. Buckets of two lines, which most are,
    are ruled out together before any text is looked at."""
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    size = np.diff(np.append(first, len(key)))
    name, label, guest = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy(zero_copy_only=False).astype(bool)
    sketch, keys = _unpacked(rows.column(6).to_pylist())
    two = first[size == 2]
    likely = ((sketch[two] == sketch[two + 1]).sum(axis=1) >= _AGREE) & ((keys[two] == keys[two + 1]).argmax(axis=1) == key[two, 0] & 15)
    likely &= ((key[two, 2] < 0) | (guest[two] != guest[two + 1])) & (label[two] != label[two + 1])
    u, v, line = [], [], rows.column(7)
    for i in two[likely].tolist():
        if similar(shingles(line[i].as_py()), shingles(line[i + 1].as_py())):
            u.append(int(name[i]))
            v.append(int(name[i + 1]))
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        cut = slice(at, at + n)
        bucket = _Bucket(int(key[at, 0]), name[cut], guest[cut], label[cut], sketch[cut], keys[cut], line.slice(at, n), bool(key[at, 2] >= 0))
        a, z = bucket.links()
        u, v = u + a, v + z
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _links(dealt: DataFrame) -> DataFrame:
    """(band, p, q, id, label, guest, sketch, line) -> (u, v): a forest of the
    links of each (band, p, q)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # batches from the first bucket that has not ended
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            rows = pa.Table.from_batches(held)
            key = _keys(rows)
            whole = int(np.flatnonzero((key != key[-1]).any(axis=1))[-1]) + 1 if (key != key[-1]).any() else 0
            if whole:
                yield _joined(rows.slice(0, whole), key[:whole])
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield _joined(rows, _keys(rows))

    dealt = dealt.select("band", "p", "q", "id", "label", "guest", "sketch", "line")
    return dealt.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q").mapInArrow(run, "u long, v long")


def _blocks(members: DataFrame, large: DataFrame, block_rows: int, guides: int) -> DataFrame:
    """(band, p, q, id, label, guest) of the first pass: whole bands, and the
    blocks of large ones with ``guides`` representatives or so in each."""
    k = F.ceil(F.coalesce("n", F.lit(0)) / block_rows)
    cut = members.join(large, "band", "left").withColumn("k", k).withColumn("own", F.when(F.col("k") > 1, F.expr("pmod(xxhash64(id, 7), k)")).otherwise(F.lit(0).cast("long")))
    guide = (F.col("k") > 1) & (F.expr("pmod(xxhash64(id, 13), n)") < guides)
    places = F.when(guide, F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).otherwise(F.array("own"))
    return cut.select("band", F.explode(places).alias("p"), F.lit(-1).cast("long").alias("q"), "id", F.col("id").alias("label"), F.lit(False).alias("guest"))


def _rest(members: DataFrame, large: DataFrame, roots: DataFrame, block_rows: int) -> DataFrame:
    """The second pass: of each large band all lines as hosts of their block,
    and those that are not in its most frequent component as guests of every
    block."""
    named = members.join(large, "band").join(roots, "id", "left").select("band", "n", "id", F.coalesce("root", "id").alias("label"))
    per = named.groupBy("band", "n", "label").agg(F.count("*").alias("c"))
    top = per.groupBy("band", "n").agg(F.max(F.struct("c", "label")).alias("top")).select(F.col("band").alias("top_band"), F.col("top.label").alias("top_label"), (F.col("n") - F.col("top.c")).alias("m"))
    every = named.join(top, named.band == top.top_band).where("m > 0").withColumn("k", F.ceil(F.col("n") / block_rows)).withColumn("r", F.ceil(F.col("m") / block_rows))
    host = every.select("band", F.expr("pmod(xxhash64(id, 7), k)").alias("p"), F.explode(F.expr("sequence(0L, r - 1)")).alias("q"), "id", "label", F.lit(False).alias("guest"))
    guest = every.where("label <> top_label").select("band", F.explode(F.expr("sequence(0L, k - 1)")).alias("p"), F.expr("pmod(xxhash64(id, 11), r)").alias("q"), "id", "label", F.lit(True).alias("guest"))
    return host.unionByName(guest)


def _bitmap(ids: DataFrame, most_bits: int = 28) -> np.ndarray:
    """A bitmap of the ids' low bits, eight for each id: it spares the shuffle
    of lines that are in no pair. It has 1 MB at least and 32 MB at most, which
    33 million ids fill; beyond that it spares less, and the join that follows
    it decides."""
    bits = min(most_bits, max(23, (8 * ids.count()).bit_length()))
    slot = F.expr(f"id & {(1 << bits) - 1}L")
    words = ids.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(id & 63L as int))").alias("b"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line, sketch) of the named lines."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_bitmap(ids))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = bits.value, set()
        mask = (len(bitmap) << 6) - 1
        for b in it:
            names, lines = [], []
            for t in b.column(0):
                for x in (t.as_py() or "").split("\n"):
                    if not x.strip(" \t\x0b\x0c\r"):
                        continue
                    n = _named(x)
                    k = n & mask
                    if n not in seen and int(bitmap[k >> 6]) >> (k & 63) & 1:
                        seen.add(n)
                        names.append(n)
                        lines.append(x)
            made = [x for at in range(0, len(lines), 2000) for x in sketches(lines[at : at + 2000])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(lines, pa.string()), pa.array(made, pa.binary())], names=["id", "line", "sketch"])
            if len(seen) > 2_000_000:
                seen.clear()

    lines = docs.select("text").mapInArrow(batches, "id long, line string, sketch binary")
    return lines.join(ids, "id", "left_semi").dropDuplicates(["id"])


def similar_lines(docs: DataFrame, lines: DataFrame, block_rows: int = 20000, guides: int = 64) -> DataFrame:
    """(id, root) of the line names that are not their component's smallest."""
    spark = docs.sparkSession
    members, members_path = _members(lines)
    texts = _texts(docs, members.select("id").distinct())
    large, large_path = stash(members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > block_rows))
    links, path = stash(_links(_blocks(members, large, block_rows, guides).join(texts, "id")))
    roots = components(links)
    if not large.isEmpty():
        more, more_path = stash(_links(_rest(members, large, roots, block_rows).join(texts, "id")))
        roots = components(links.unionByName(more))
        discard(spark, more_path)
    for one in (members_path, large_path, path):
        discard(spark, one)
    return roots


def _decisions(docs: DataFrame) -> DataFrame:
    lines, _ = stash(line_table(docs))
    roots = similar_lines(docs, lines)
    every = lines.select("doc_id", "text_hash", F.posexplode("lines").alias("line_no", "line_id")).where("line_id <> 0")
    rooted = every.join(roots, every.line_id == roots.id, "left").select("doc_id", "text_hash", "line_no", "line_id", F.coalesce("root", "line_id").alias("root"))
    place = F.struct(F.col("doc_id").isNull().alias("nowhere"), "doc_id", "text_hash", "line_no")
    first = rooted.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Read from a table, so that the join can split a hot component's lines.
    many, _ = stash(first.where("n > 1").select("root", "first"))
    return rooted.join(many, "root", "left").withColumn("first", F.coalesce("first", place)).select(
        "doc_id", "text_hash", "line_no", "line_id", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"),
        F.col("first").eqNullSafe(place).alias("kept"),
    )


def line_decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line_id, first_doc, first_line, kept) of every line
    with a word; (first_doc, first_line) is the line its component keeps."""
    return _decisions(docs).drop("text_hash")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that are not kept. A document that loses all
    of its lines that hold a word goes; one that had none stays as it is."""
    gone_name = free_name(docs, "gone_lines")
    gone = (
        _decisions(docs)
        .where("not kept")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("line_no").alias(gone_name))
        .select(F.col("doc_id").alias("gone_doc"), F.col("text_hash").alias("gone_hash"), gone_name)
    )
    joined = docs.join(gone, docs.doc_id.cast("long").eqNullSafe(gone.gone_doc) & (F.xxhash64(docs.text) == gone.gone_hash), "left")
    lost = gone[gone_name]
    left = F.filter(F.split(docs.text, "\n"), lambda x, i: ~F.array_contains(lost, i))
    text = F.when(lost.isNull(), docs.text).otherwise(F.array_join(left, "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost.isNull(), docs.n_chars).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    kept = joined.where(lost.isNull() | text.rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
