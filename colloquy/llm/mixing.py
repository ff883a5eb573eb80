"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of times each of its words
should be taken. The whole part of that is certain; the fraction is a copy
probability. Two documents of a source meet, and mass moves between them at
random, the sum of probability times size unchanged, until one has probability
zero or one. The other goes on to the next meeting. A source's last undecided
document takes the nearer whole number; the words that this adds or lacks are
made up by single copies of documents of that last meeting, largest first.

Documents meet in groups of about ``group_rows`` of a source, so a hot source
is many groups; each group leaves one undecided document at most and a few of
all sizes, as change, and these meet in a tree of ``fan_in`` groups a node
until one is left.

Defined results: null text has size 0; a null source is a source of its own,
ordered last; null doc_ids and repeated rows are documents like any other; with
no words at all every target is 0; extra columns are ignored; an empty table
gives an empty result. Draws come from the ids and the seed: reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash, text_or_empty

_PLAN = "doc_id long, source string, size long, source_size long, target double, whole long, p double, groups long, bucket long, copies long"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target): weights by code point order of
    the source, all words shared out, no target above ``most`` times its
    source's size. The level at which the rest is shared comes from one sort of
    the sources by the level that fills them. The windows hold one row for each
    source, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    weighed = per.withColumn("weight", weight).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = weighed.select(
        "*",
        F.sum("source_size").over(every).alias("all_words"),
        F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)).alias("full_words"),
        F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_weight"),
    ).withColumn("level", (F.col("all_words") - F.col("full_words")) / F.col("open_weight"))
    # The first source that the level does not fill fixes the level of all after it.
    first = F.when(F.col("level") <= F.col("full_at"), F.struct(F.row_number().over(fill).alias("at"), "level"))
    level = shared.withColumn("first", first).withColumn("final", F.min("first").over(every)["level"])
    return level.select(
        "source", "source_size", "n_docs",
        F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.coalesce("final", F.lit(0.0))).alias("target"),
    )


def _settle(seed: int, level: int, last: bool, change: int = 24):
    """Pivotal rounding of one group; ``last`` also settles what is left.
    Before that a group passes ``change`` documents of all sizes on as well."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "p"], ascending=[False, True, True], kind="stable", ignore_index=True)
        draw = np.random.default_rng([seed, level, zlib.crc32(repr((key[0] if isinstance(key[0], str) else None, int(key[1]))).encode())])
        p, size = rows["p"].to_numpy(copy=True), rows["size"].to_numpy().astype(float)
        coin = draw.random(len(p) + 1)
        taken = np.full(len(p), -1, dtype=np.int64)
        at = -1  # the document that goes on, undecided
        passed = set() if last else set(np.linspace(0, len(p) - 1, change).astype(int).tolist())
        for i in range(len(p)):
            if i in passed:
                continue
            if at < 0:
                at = i
            else:
                ratio = size[i] / size[at]
                up, down = min(1 - p[at], p[i] * ratio), min(p[at], (1 - p[i]) * ratio)
                if coin[i] * (up + down) < down:
                    p[at], p[i] = p[at] + up, p[i] - up / ratio
                else:
                    p[at], p[i] = p[at] - down, p[i] + down / ratio
            for j in (at, i):
                if taken[j] < 0 and (p[j] < 1e-9 or p[j] > 1 - 1e-9):
                    taken[j] = int(p[j] > 0.5)
            at = i if taken[at] >= 0 and taken[i] < 0 else -1 if taken[at] >= 0 else at
        if last and at >= 0:
            taken[at] = int(p[at] >= 0.5)
            over = (taken[at] - p[at]) * size[at]
            for i in range(len(p)):  # by size, largest first
                if i != at and size[i] < 2 * abs(over) and taken[i] == int(over > 0):
                    taken[i], over = 1 - taken[i], over - size[i] if over > 0 else over + size[i]
        rows["p"] = p
        rows["copies"] = pd.Series(taken, dtype="Int64").where(taken >= 0) + rows["whole"]
        return rows

    return run


def _numbered(sized: DataFrame, block: int = 100_000) -> DataFrame:
    """``sized`` with ``nth``, which tells equal rows apart, such as those
    without an id, so that they spread over groups. Equal rows are counted with
    map-side combine and laid out again in blocks, not in one task."""
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    dealt = blocks.repartition("doc_id", "size", "block")
    first, last = F.col("block") * block, F.least(F.col("n"), (F.col("block") + 1) * block) - 1
    return dealt.select("doc_id", "source", "size", F.explode(F.sequence(first, last)).alias("nth"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, group_rows: int = 2000, fan_in: int = 64, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row."""
    sized, _ = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD + "+")).cast("long").alias("size")))
    goals, _ = stash(targets(sized, weights, most))
    deepest = goals.agg(F.max("n_docs")).first()[0] or 0
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    goal = goals.withColumnRenamed("source", "goal_source")
    planned = (
        _numbered(sized)
        .join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .withColumn("share", share)
        .withColumn("whole", F.floor("share"))
        .withColumn("groups", F.ceil(F.col("n_docs") / group_rows))
        .select(
            "doc_id", "source", "size", "source_size", "target", "whole",
            F.when(F.col("size") > 0, F.col("share") - F.col("whole")).otherwise(F.lit(0.0)).alias("p"),
            "groups", F.expr("pmod(xxhash64(doc_id, size, nth), groups)").alias("bucket"),
        )
    )
    settled = [planned.where("p = 0").withColumn("copies", F.col("whole"))]
    groups, level = max(1, -(-deepest // group_rows)), 0
    open_rows = planned.where("p > 0").withColumn("copies", F.lit(None).cast("long"))
    while True:
        last = groups == 1
        done, _ = stash(open_rows.groupBy("source", "bucket").applyInPandas(_settle(seed, level, last), _PLAN))
        settled.append(done.where("copies is not null"))
        if last:
            break
        open_rows = done.where("copies is null").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        groups, level = -(-groups // fan_in), level + 1
    out = None
    for part in settled:
        part = part.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
        out = part if out is None else out.unionByName(part)
    return out
