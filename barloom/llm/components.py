"""Connected components by alternating large-star and small-star.

Every step joins aggregated minima: a node with many neighbours is reduced by a partial aggregate, and its edges
are dealt to many parts when they meet the minimum, so its neighbours never meet in one list or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hub_join


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return hub_join(both.where("v > u"), least, "u", "n", 2 * n, F.xxhash64("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them (edges come as u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = hub_join(edges, least, "u", "n", n, F.xxhash64("v")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the smallest reachable node.

    Nulls, loops and repeated edges are dropped; an empty edge table gives an empty result.
    Rounds are written to the shared folder, so a lost executor repeats one round at most.
    """
    now = scratch.put(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = None
    for _ in range(max_rounds):
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark or sums[0] == 0:
            break
        mark = tuple(sums)
        after = scratch.put(_small_star(_large_star(now, sums[0]), sums[0]).distinct(), "star")
        scratch.drop(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every node points at its smallest node; roots stand on the right only
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
