"""MinHash near-duplicates by an LSH forest.

A document is the set of its word shingles; equal sets collapse first, so a
group of copies is one row a task. A set has ``TREES`` signature orders of up to
``DEPTH`` minima each. In an order, sets that share a prefix are a region, and
the neighbours with the longest common prefix are candidates: a region of few
sets stops at four minima, denser ones go on to five or six. Two sets of
Jaccard 0.8 share a region of depth four in some order but for a chance of
3e-5, and of depth six but for 2e-3; at 0.85 these are 4e-7 and 8e-5.

The orders are taken in three rounds. Each begins with the components found so
far and looks only at regions that hold more than one, so copies that an early
order joins cost later rounds nothing. Within a region byte sketches of all
minima and the set sizes rule pairs out (a pair at Jaccard 0.8 with probability
1e-6); the texts of what is left meet in one task, which compares full sets and
skips pairs that it has joined. Tasks emit a forest of links, and distributed
union-find joins the forests.

A region that is too large for a task, in rows or shingles, is cut into blocks
that share representatives; in a second pass the sets outside of its most
frequent component meet every block. So no link that a region offers is lost,
and no pairs are listed. Keys that many rows hold are joined by a broadcast of
those keys alone, of which there are fewer than four a shuffle partition.

Defined results: null texts and texts without a word have an empty set, link
with nothing and keep their own doc_id; a text of fewer words than a shingle
takes is one shingle; a row without a doc_id joins others, whose smallest
doc_id names the component (null if none has one), and is kept only there;
repeated rows and doc_ids repeat; extra columns are ignored; an empty table
gives an empty result. Sets are named by 64-bit hashes of their shingles'
64-bit hashes; two different ones agree with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash
from .graph import components

#: A link's likeness in hundredths, and the forest that finds it.
LIKENESS = 80
TREES, SHALLOW, DEPTH = 20, 4, 6
ROUNDS = (range(1), range(1, 4), range(4, TREES))
_MINIMA = TREES * DEPTH
_AGREE = 74
_DRAW = np.random.default_rng(23)
_TIMES = _DRAW.integers(0, 1 << 63, size=_MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(0, 1 << 63, size=_MINIMA, dtype=np.uint64)
_ODD = _DRAW.integers(0, 1 << 63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A-Z to a-z, every other byte to itself.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[14]
    x = (x ^ (x >> np.uint64(27))) * _ODD[15]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words_each: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < words_each:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w) for w in words], dtype=np.uint64)
    n = len(own) - words_each + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(words_each):
        out = _mix(out + own[k : k + n] * _ODD[k % 8])
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the ``TREES * DEPTH`` hash functions."""
    least = np.full(_MINIMA, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        block = shingles[at : at + 2048]
        least = np.minimum(least, ((block[:, None] * _TIMES + _PLUS) >> np.uint64(32)).min(axis=0))
    return least


def signatures(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of minima: (a key a tree of its first four, a byte a minimum)."""
    by_tree = least.reshape(len(least), TREES, DEPTH)
    key = np.broadcast_to(np.arange(TREES, dtype=np.uint64) * _ODD[8], by_tree.shape[:2]).copy()
    for k in range(SHALLOW):
        key = _mix(key + by_tree[:, :, k] * _ODD[9])
    return key.view(np.int64), _mix(least + _ODD[10]).astype(np.uint8)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= LIKENESS * union."""
    if 100 * min(len(a), len(b)) < LIKENESS * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LIKENESS * (len(a) + len(b) - both)


def document_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, id, keys, sketch, text): a row for each document; ``id``
    names its set, null where that is empty. The last three columns are null
    where the task has met the set before."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in it:
            at = 0
            while at < b.num_rows:
                end, chars = at, 0
                while end < b.num_rows and (end == at or chars < 4_000_000) and end - at < 2000:
                    chars += len(b.column(1)[end].as_py() or "")
                    end += 1
                sizes, ids, least, texts = [], [], [], []
                for t in b.column(1).slice(at, end - at).to_pylist():
                    own = shingle_set(t)
                    sizes.append(len(own))
                    name = int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)) if len(own) else None
                    fresh = name is not None and name not in seen
                    ids.append(name)
                    texts.append(t if fresh else None)
                    if fresh:
                        seen.add(name)
                        least.append(minima(own))
                keys, sketch = signatures(np.array(least, dtype=np.uint64).reshape(-1, _MINIMA))
                signed = iter(zip(keys.tolist(), map(bytes, sketch), strict=True))
                both = [next(signed) if t is not None else (None, None) for t in texts]
                columns = [
                    b.column(0).slice(at, end - at), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                    pa.array([x[0] for x in both], pa.list_(pa.int64())), pa.array([x[1] for x in both], pa.binary()), pa.array(texts, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "id", "keys", "sketch", "text"])
                at = end
                if len(seen) > 2_000_000:  # only spares work; sets may come again
                    seen.clear()

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return asked.mapInArrow(batches, "doc_id long, n long, id long, keys array<long>, sketch binary, text string")


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``keyed``, which has one row a key with ``c``, the
    number of rows that hold it, of ``total``. Keys of more than a fourth of a
    partition's share are fewer than four a partition: they are broadcast, and
    their rows stay where they are."""
    share = total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hubs = F.broadcast(keyed.where(F.col("c") > share))
    other = rows.join(F.broadcast(keyed.where(F.col("c") > share).select(key)), key, "left_anti")
    return rows.join(hubs, key).unionByName(other.join(keyed.where(F.col("c") <= share), key))


def _likely(sketch: np.ndarray, n: np.ndarray, i: int, far: np.ndarray) -> np.ndarray:
    """Which of ``far`` may be similar to ``i``."""
    far = far[100 * np.minimum(n[far], n[i]) >= LIKENESS * np.maximum(n[far], n[i])]
    return far[(sketch[far] == sketch[i]).sum(axis=1) >= _AGREE]


def _groups(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that agree in ``names``, by which they are sorted."""
    held: list[pa.Table] = []
    last = None
    for b in it:
        rows = pa.Table.from_batches([b])
        if not len(rows):
            continue
        key = np.column_stack([rows.column(c).to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(key[lo]) != last:
                yield pa.concat_tables(held)
                held = []
            last = tuple(key[lo])
            held.append(rows.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)


def _sketches(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, _MINIMA)


def _flagged(rows: DataFrame) -> DataFrame:
    """(region, id, root): the sets of each region that may be similar to one
    of another component."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(it, ["region"]):
            if len(group) < 2:
                continue
            _, label = np.unique(group.column("root").to_numpy(), return_inverse=True)
            sketch, n = _sketches(group), group.column("n").to_numpy()
            hit = np.zeros(len(group), dtype=bool)
            for i in range(len(group) - 1):
                far = _likely(sketch, n, i, i + 1 + np.flatnonzero(label[i + 1 :] != label[i]))
                hit[far] = True
                hit[i] |= len(far) > 0
            if hit.any():
                yield group.filter(pa.array(hit)).select(["region", "id", "root"]).combine_chunks().to_batches()[0]

    dealt = rows.select("region", "id", "root", "n", "sketch")
    return dealt.repartition("region").sortWithinPartitions("region").mapInArrow(run, "region long, id long, root long")


def _joined(group: pa.Table) -> tuple[list[int], list[int]]:
    """A forest of the links within a group. Guests, if any, come first and
    are compared with hosts alone. A set whose text several tasks kept is here
    several times and counts once."""
    name, guest = group.column("id").to_numpy(), group.column("guest").to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((name, ~guest))
    order = order[np.r_[True, (name[order][1:] != name[order][:-1]) | (guest[order][1:] != guest[order][:-1])]]
    name, guests = name[order], int(guest[order].sum())
    _, label = np.unique(group.column("root").to_numpy()[order], return_inverse=True)
    sketch, n, text = _sketches(group)[order], group.column("n").to_numpy()[order], group.column("text")
    sets: dict[int, np.ndarray] = {}
    across = bool(group.column("q")[0].as_py() >= 0)

    def own(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(text[int(order[i])].as_py())
        return sets[i]

    u, v = [], []
    for i in range(guests if across else len(name) - 1):
        begin = guests if across else i + 1
        for j in _likely(sketch, n, i, begin + np.flatnonzero(label[begin:] != label[i])).tolist():
            if label[j] != label[i] and similar(own(i), own(j)):
                label[label == label[j]] = label[i]
                u.append(int(name[i]))
                v.append(int(name[j]))
        sets.pop(i, None)
    return u, v


def _links(dealt: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(region, p, q, id, root, guest) -> (u, v), a forest a (region, p, q)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(it, ["region", "p", "q"]):
            if len(group) > 1:
                u, v = _joined(group)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    met = dealt.join(sets.select("id", "n", "sketch"), "id").join(texts, "id").select("region", "p", "q", "id", "root", "guest", "n", "sketch", "text")
    return met.repartition("region", "p", "q").sortWithinPartitions("region", "p", "q").mapInArrow(run, "u long, v long")


def _with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _regions(rows: DataFrame, key: str) -> DataFrame:
    """(key, c, w): rows and shingles of the regions of several components."""
    found = rows.groupBy(key).agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return found.where("lo <> hi").select(key, "c", "w")


def _round(sets: DataFrame, texts: DataFrame, roots: DataFrame | None, trees: range, dense: int, block_rows: int, block_shingles: int) -> DataFrame:
    """The roots after the orders ``trees``."""
    spark = sets.sparkSession
    place = F.posexplode(F.slice("keys", trees.start + 1, len(trees))).alias("tree", "key")
    deeper = F.expr(f"substring(sketch, (tree + {trees.start}) * {DEPTH} + {SHALLOW + 1}, {DEPTH - SHALLOW})").alias("deeper")
    each, each_path = stash(_with_roots(sets.select("id", "n", "keys", "sketch"), roots).select("id", "n", "root", "sketch", place).select("id", "n", "root", "key", deeper))
    total = each.count()
    open_regions, open_path = stash(_regions(each, "key"))
    met = join_counted(each, open_regions, "key", total)
    fits = (F.col("c") <= dense) & (F.col("w") <= block_shingles)
    single = met.where(fits).select(F.col("key").alias("region"), "id", "root")
    paths = [each_path, open_path]
    large = None
    if not open_regions.where(~fits).isEmpty():
        # Denser regions take one minimum more, the densest two.
        region = F.when(F.col("c") <= 64 * dense, F.xxhash64("key", F.substring("deeper", 1, 1))).otherwise(F.xxhash64("key", "deeper"))
        deep, deep_path = stash(met.where(~fits).select(region.alias("region"), "id", "n", "root"))
        blocks = F.greatest(F.ceil(F.col("c") / block_rows), F.ceil(F.col("w") / block_shingles))
        closer, closer_path = stash(_regions(deep, "region").withColumn("k", blocks).drop("w"))
        paths += [deep_path, closer_path]
        cut = join_counted(deep, closer, "region", total)
        single = single.unionByName(cut.where("k = 1").select("region", "id", "root"))
        if not closer.where("k > 1").isEmpty():
            large, large_path = stash(cut.where("k > 1").select("region", "id", "root", "c", "k"))
            paths.append(large_path)
    likely = _flagged(single.join(sets.select("id", "n", "sketch"), "id"))
    whole = lambda rows: rows.select("region", F.lit(0).cast("long").alias("p"), F.lit(-1).cast("long").alias("q"), "id", "root", F.lit(False).alias("guest"))
    dealt = whole(likely)
    if large is not None:
        guide = F.expr("pmod(xxhash64(id, 13), c) < 16")
        at = F.when(guide, F.expr("sequence(0L, k - 1)")).otherwise(F.array(F.expr("pmod(xxhash64(id, 7), k)")))
        dealt = dealt.unionByName(large.select("region", F.explode(at).alias("p"), F.lit(-1).cast("long").alias("q"), "id", "root", F.lit(False).alias("guest")))
    links, path = stash(_links(dealt, sets, texts))
    edges = links if roots is None else links.unionByName(roots.select(F.col("id").alias("u"), F.col("root").alias("v")))
    after = components(edges)
    if large is not None:
        more, more_path = stash(_links(_rest(large, after, block_rows), sets, texts))
        after = components(edges.unionByName(more))
        paths.append(more_path)
    for p in [*paths, path]:
        discard(spark, p)
    return after


def _rest(large: DataFrame, roots: DataFrame, block_rows: int) -> DataFrame:
    """The second pass over large regions: all sets as hosts of their block,
    and those outside of the region's most frequent component as guests of
    every block."""
    named, total = _with_roots(large.drop("root"), roots), large.count()
    per = named.groupBy("region", "c", "root").agg(F.count("*").alias("own"))
    top = per.groupBy("region", "c").agg(F.max(F.struct("own", "root")).alias("top")).select("region", "c", F.col("top.root").alias("most"), (F.col("c") - F.col("top.own")).alias("m"))
    every = join_counted(named.drop("c"), top, "region", total).where("m > 0").withColumn("r", F.ceil(F.col("m") / block_rows))
    spots = lambda p, q: (F.explode(F.expr(p)).alias("p"), F.expr(q).alias("q"))
    host = every.select("region", *spots("array(pmod(xxhash64(id, 7), k))", "r"), "id", "root").withColumn("q", F.explode(F.expr("sequence(0L, q - 1)"))).withColumn("guest", F.lit(False))
    guest = every.where("root <> most").select("region", *spots("sequence(0L, k - 1)", "pmod(xxhash64(id, 11), r)"), "id", "root").withColumn("guest", F.lit(True))
    return host.select("region", "p", "q", "id", "root", "guest").unionByName(guest)


def near_duplicates(docs: DataFrame, dense: int = 128, block_rows: int = 2048, block_shingles: int = 1 << 22) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    rows, _ = stash(document_sets(docs))
    sets, sets_path = stash(rows.where("sketch is not null").select("id", "n", "keys", "sketch").dropDuplicates(["id"]))
    texts = rows.where("text is not null").select("id", "text")
    roots = None
    for trees in ROUNDS:
        roots = _round(sets, texts, roots, trees, dense, block_rows, block_shingles)
    least = rows.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    labelled, _ = stash(_with_roots(least, roots))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    of, _ = stash(join_counted(labelled.withColumnRenamed("c", "rows"), named, "root", labelled.count()).select("id", F.col("rows").alias("c"), "component_id"))
    discard(spark, sets_path)
    own = rows.select("doc_id", F.col("n").alias("n_shingles"), "id")
    found = join_counted(own.where("id is not null"), of, "id", rows.count())
    alone = own.where("id is null").withColumn("component_id", F.col("doc_id"))
    every = found.select("doc_id", "n_shingles", "component_id").unionByName(alone.drop("id"))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
