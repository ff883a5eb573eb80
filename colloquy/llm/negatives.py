"""Hard-negative mining with Kronecker-packed products.

Vectors become integers, floor(256 x). A task holds one group of candidates:
for each dimension the components of all of them, made non-negative by a bias,
stand in separated fields of one wide integer. An anchor multiplies each wide
integer once by its own component and adds up; the fields of the sum are the
exact inner products with every candidate of the group. Fields are as wide as
the largest possible sum needs, so nothing carries over, whatever the numbers.

Two passes deal the rows alike: candidates into groups of bounded size by their
place in the table, so that equal rows and a label that many rows share spread
evenly, and each anchor to every group. The first pass finds an anchor's
positives among the candidates of its label, the second its negatives, as the
bounds of a negative's score follow from the positive's. A group gives no more
than ``k`` rows for an anchor and positive; their final order is a window over
those. No anchors or candidates pass through the driver or a broadcast.

Defined results: rows with a null label, a null vector, or a component that is
null or not finite take no part; a vector that is shorter than another counts
as ending in zeros; "other rows" are those with another vec_id (rows without
one are other rows of all, sort last, and are no anchors); repeated rows are
candidates each, repeated anchors that agree in label and vector count once;
a score beyond 64 bits counts as the nearest long; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stash

_LEAST, _MOST = -(2**63) + 1, 2**63 - 1
_OUT = "a long, slot int, vec_id long, score long"


def prepared(vectors: DataFrame, relabel_every: int = 7, classes: int = 10) -> DataFrame:
    """(vec_id, label, x array<double>) of the rows that take part; where
    vec_id is divisible by ``relabel_every`` the label is the next one."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: F.coalesce((v - v) == 0, F.lit(False)) & ~F.isnan(v))
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    return given.where(F.col("label").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", moved.alias("label"), "x")


def scaled(x: pa.ListArray, scale: int = 256) -> np.ndarray:
    """(rows, dimensions): floor(scale * component) as int64, or as Python
    integers where these are too large; short vectors are filled with zeros."""
    flat = x.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(x.offsets.to_numpy())
    wide = int(sizes.max(initial=0))
    small = not len(flat) or np.abs(flat).max() < 2.0**44
    ints = np.floor(scale * flat).astype(np.int64) if small else np.array([int(v) * scale if abs(v) > 2.0**60 else math.floor(v * scale) for v in flat.tolist()], dtype=object)
    out = np.zeros((len(sizes), wide), dtype=ints.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = ints
    return out


def _widened(m: np.ndarray, wide: int) -> np.ndarray:
    return m if m.shape[1] == wide else np.hstack([m, np.zeros((len(m), wide - m.shape[1]), dtype=m.dtype)])


class Packed:
    """Candidates whose components stand in fields of wide integers."""

    def __init__(self, components: np.ndarray):
        self.n, self.components = len(components), components
        self.bias = max(0, -int(components.min(initial=0)))
        self.top = int(components.max(initial=0)) + self.bias
        self.total = components.sum(axis=1)
        self.made: dict[tuple[int, int], list[int]] = {}

    def _wide(self, field: int, dimensions: int) -> list[int]:
        """An integer for each dimension, ``field`` bytes for each candidate."""
        if (field, dimensions) not in self.made:
            biased = (_widened(self.components, dimensions) + self.bias).T
            if field <= 8:
                raw = [row.astype(f"<u{field}").tobytes() for row in biased]
            else:
                raw = [b"".join(int(v).to_bytes(field, "little") for v in row) for row in biased]
            self.made[field, dimensions] = [int.from_bytes(b, "little") for b in raw]
        return self.made[field, dimensions]

    def products(self, anchors: np.ndarray) -> Iterator[np.ndarray]:
        """The inner products of all candidates with each of ``anchors``."""
        d = max(anchors.shape[1], self.components.shape[1])
        anchors = _widened(anchors, d)
        bias = max(0, -int(anchors.min(initial=0)))
        most = d * self.top * (int(anchors.max(initial=0)) + bias)
        field = 4 if most < 2**31 else 8 if most < 2**62 else most.bit_length() // 8 + 1
        wide = self._wide(field, d)
        back = bias * self.total + d * bias * self.bias if field <= 8 else [bias * int(t) + d * bias * self.bias for t in self.total]
        for row in anchors:
            own = row.tolist()
            packed = sum(map(mul, wide, [v + bias for v in own]))
            raw = packed.to_bytes(field * self.n, "little")
            if field <= 8:
                yield np.frombuffer(raw, dtype=f"<u{field}").astype(np.int64) - self.bias * sum(own) - back
            else:
                exact = (int.from_bytes(raw[i * field : (i + 1) * field], "little") - self.bias * sum(own) - back[i] for i in range(self.n))
                yield np.array([min(_MOST, max(_LEAST, v)) for v in exact], dtype=np.int64)


class _Group:
    """The candidates of a task's group; packed as a whole and by label."""

    def __init__(self, rows: pa.Table):
        vec = rows.column("vec_id").combine_chunks()
        label = rows.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label, self.none = label[order], np.asarray(vec.is_null())[order]
        self.vec = vec.fill_null(0).to_numpy()[order]
        self.components = scaled(rows.column("x").combine_chunks())[order]
        self.packs: dict[object, Packed] = {}

    def pack(self, part: slice, name: object) -> Packed:
        if name not in self.packs:
            self.packs[name] = Packed(self.components[part])
        return self.packs[name]

    def first(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Of positions ``at``, the first k by score, then vec_id, null last."""
        if len(at) > 4 * k:
            own = score[at]
            at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
        return at[np.lexsort((self.vec[at], self.none[at], -score[at]))[:k]]


def bounds(positive: int, least: int = 30, most: int = 90) -> tuple[int, int]:
    """The scores s with least * positive <= 100 * s <= most * positive."""
    return -((-least * positive) // 100), (most * positive) // 100


def _positives(group: _Group, rows: pa.Table, k: int) -> Iterator[tuple]:
    label = rows.column("label").to_numpy()
    anchors = scaled(rows.column("x").combine_chunks())
    vec, key = rows.column("vec_id").to_numpy(), rows.column("a").to_numpy()
    for own in np.unique(label):
        lo, hi = np.searchsorted(group.label, [own, own + 1])
        mine = np.flatnonzero(label == own)
        if lo == hi:
            continue
        for i, part in zip(mine, group.pack(slice(lo, hi), int(own)).products(anchors[mine]), strict=True):
            score = np.zeros(len(group.label), dtype=np.int64)
            score[lo:hi] = part
            others = lo + np.flatnonzero((group.vec[lo:hi] != vec[i]) | group.none[lo:hi])
            best = group.first(others, score, k)
            yield key[i], 0, best, score[best]


def _negatives(group: _Group, rows: pa.Table, k: int) -> Iterator[tuple]:
    label, wanted, key = rows.column("label").to_numpy(), rows.column("wanted").to_pylist(), rows.column("a").to_numpy()
    anchors = scaled(rows.column("x").combine_chunks())
    for i, score in enumerate(group.pack(slice(None), None).products(anchors)):
        other = group.label != label[i]
        for slot, positive in enumerate(wanted[i]):
            lo, hi = bounds(positive)
            best = group.first(np.flatnonzero(other & (score >= lo) & (score <= hi)), score, k)
            yield key[i], slot, best, score[best]


def _scan(find, k: int):
    def found(group: _Group, anchors: pa.Table) -> pa.RecordBatch:
        key, slot, at, score = [], [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a, s, best, own in find(group, anchors, k):
            key += [a] * len(best)
            slot += [s] * len(best)
            at.append(best)
            score.append(own)
        place = np.concatenate(at).astype(np.int64)
        vec = pa.array(group.vec[place], pa.int64(), mask=group.none[place])
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(slot, pa.int32()), vec, pa.array(np.concatenate(score), pa.int64())], names=["a", "slot", "vec_id", "score"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, its candidates before its anchors."""
        held: list[pa.Table] = []
        group, of = None, None
        for b in it:
            rows = pa.Table.from_batches([b])
            p, anchor = rows.column("p").to_numpy(), rows.column("anchor").to_numpy()
            cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (anchor[1:] != anchor[:-1])) + 1).tolist(), len(p)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if p[lo] != of:
                    held, group, of = [], None, p[lo]
                part = rows.slice(lo, hi - lo)
                if not anchor[lo]:
                    held.append(part)
                elif held or group:
                    if group is None:
                        group, held = _Group(pa.concat_tables(held)), []
                    for at in range(0, len(part), 512):
                        yield found(group, part.slice(at, 512))

    return run


def _dealt(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Each of ``rows`` in one group, each of ``anchors`` in all of them."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    own = rows.select(place.alias("p"), F.lit(0).alias("anchor"), F.lit(None).cast("long").alias("a"), "vec_id", "label", "x", F.lit(None).cast("array<long>").alias("wanted"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("p"), F.lit(1).alias("anchor"), "a", "vec_id", "label", "x", "wanted")
    return own.unionByName(asked).repartition("p").sortWithinPartitions("p", "anchor")


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, group_rows: int = 16384) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id,
    positive_score, negative_score) for all anchors of ``vectors``."""
    spark = vectors.sparkSession
    rows = prepared(vectors)
    groups = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // group_rows))
    asked = rows.where(F.col("vec_id") % anchor_every == 0).distinct().select(F.monotonically_increasing_id().alias("a"), "vec_id", "label", "x")
    anchors, _ = stash(asked)
    plain = anchors.withColumn("wanted", F.lit(None).cast("array<long>"))
    near = _dealt(rows, plain, groups).mapInArrow(_scan(_positives, positives), _OUT)
    best, _ = stash(_ranked(near.drop("slot"), ["a"], positives).select("a", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = best.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))
    far, path = stash(_dealt(rows, anchors.join(wanted, "a"), groups).mapInArrow(_scan(_negatives, negatives), _OUT))
    ranked, _ = stash(_ranked(far, ["a", "slot"], negatives))
    discard(spark, path)
    named = ranked.join(best, ["a", "slot"]).join(anchors.select("a", F.col("vec_id").alias("anchor_id")), "a")
    return named.select(
        "anchor_id", "positive_id", (F.col("slot") + 1).alias("positive_rank"), F.col("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def oracle() -> str:
    """The query in DuckDB's SQL. Sums of products are whole numbers under
    2**53 for vectors of these tables, so doubles hold them exactly."""
    return """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_dot_product(a.x, r.x)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INTEGER AS positive_rank
  FROM pairs WHERE label = own QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, p.positive_id, p.positive_rank, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label <> n.own
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
