"""Connected components over an edge table, by alternating stars.

Each round is two joins and two aggregations on the edge table, so no vertex
list, edge list or component passes through the driver or one task. A vertex
with more than its share of all edges is a hub: fewer than eight hubs for each
shuffle partition can exist, so their least neighbours are broadcast, and only
the edges of other vertices are dealt by vertex. Aggregations combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _with_least(edges: DataFrame, share: int) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of its u. ``share`` edges
    make a hub."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > share).select("u", F.col("m").alias("hub_m")))
    dealt = edges.join(hubs, "u", "left")
    rest = dealt.where("hub_m is null").select("u", "v").join(least.where(F.col("n") <= share).select("u", "m"), "u")
    return rest.select("u", "v", "m").unionByName(dealt.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def _large_star(edges: DataFrame, share: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, share).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, share: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, share)
    # The edge to the least neighbour itself keeps its place.
    return found.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _settled(edges: DataFrame) -> tuple[bool, int]:
    """Whether every vertex has one parent at most and no parent has one; and
    the number of edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("e"))
    per = ends.groupBy("e.id").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    open_ends = F.max(F.expr("ups > 1 OR (ups = 1 AND least = 0)"))
    row = per.agg(open_ends.alias("open_ends"), F.sum("ups").alias("n")).first()
    return not row["open_ends"], row["n"] or 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long) -> (id, root): one row for each vertex that
    is not itself the smallest of its component. Self loops and repeats are
    allowed; an empty table gives an empty table. ``edges`` is read more than
    once: hand in a table that is written."""
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.select("u", "v").where("u <> v")
    current, path = stash(_small_star(edges, edges.count() // (4 * parts)))
    for _ in range(max_rounds):
        done, n = _settled(current)
        if done:
            return current.select(F.col("u").alias("id"), F.col("v").alias("root"))
        share = n // (4 * parts)
        following, next_path = stash(_small_star(_large_star(current, share), share))
        discard(spark, path)
        current, path = following, next_path
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
