"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step, over edges (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    turned = large.join(least, "u")
    down = turned.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node with an edge (a, b) to another; root is the least node of its component.

    Alternates large-star and small-star steps, which take a number of rounds in the order of the logarithm of the
    size of a component, and saves each round in the shared folder. Joins are on a node with all its neighbours at
    most; adaptive execution splits those that stand out. Null ends and loops are left out.
    """
    edges = edges.select("a", "b").where("a != b")
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda frame: tuple(frame.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = saved(_stars(now))
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
