"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is its least node.

    Alternates large-star and small-star steps until the edge list is a set of stars: two
    steps need about log2 of the longest chain. Each step takes minima by node, which
    combine before the shuffle, and joins them back; no neighbour list is ever collected.
    Self loops and repeated edges are allowed; rows with a null end are dropped.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    edges = cut(edges)
    last = None
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)).where("u <> v").distinct())
        sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        own.select("node", F.col("node").alias("component"))
    )
