"""Connected components by contraction: every node hangs on its least neighbour, trees shrink to their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import held


def _roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with each node's parent replaced by the root of its tree; paths halve each time."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        stepped = held(parents.join(above, "parent").select("node", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("moved")))
        parents = stepped.select("node", "parent")
        if not stepped.where("moved").head(1):
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v): component is the same for nodes that edges connect.

    In each round a node's parent is the least of itself and its neighbours, an aggregate that
    combines before the shuffle; the trees are shrunk to their roots and the edges between roots
    are what is left. A tree has two nodes or more, so the nodes at least halve: a chain or a star
    of n nodes takes about log2 n rounds at most, and no neighbour list is ever held. Null ends are
    left out; loops and repeated edges count for nothing.
    """
    left = held(edges.where("u is not null and v is not null").select("u", "v").distinct())
    found = left.select(F.col("u").alias("node")).union(left.select("v")).distinct().withColumn("component", F.col("node"))
    left = left.where("u <> v")
    while left.head(1):
        both = left.union(left.select("v", "u"))
        roots = _roots(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("parent")))
        found = held(
            found.join(roots.select(F.col("node").alias("component"), F.col("parent").alias("_root")), "component", "left")
            .select("node", F.coalesce("_root", "component").alias("component"))
        )
        ends = left
        for end in ("u", "v"):
            ends = ends.join(roots.select(F.col("node").alias(end), F.col("parent").alias(f"_{end}")), end)
        left = held(ends.select(F.col("_u").alias("u"), F.col("_v").alias("v")).where("u <> v").distinct())
    return found
