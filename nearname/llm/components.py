"""Connected components by alternating contraction of a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearname.session import reliable_checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); root is the smallest node
    it can reach.

    Each round every node learns the smallest neighbour, chains are followed once (a node takes
    the parent of its parent), and edges are redrawn between parents; edges inside a tree
    vanish. The number of live edges falls at least by half per round on any graph, and a star
    ends in one. Every step is a grouped minimum or an equi-join, and each round is written to
    the shared folder.
    """
    live = reliable_checkpoint(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    parents = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent"))
        lowest = reliable_checkpoint(lowest)
        up = lowest.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        step = reliable_checkpoint(lowest.join(up, "parent").select("node", F.col("_up").alias("parent")))
        if parents is None:
            parents = step
        else:
            now = step.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
            moved = parents.join(now, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"))
            fresh = step.join(parents.select("node"), "node", "left_anti")
            parents = reliable_checkpoint(moved.unionByName(fresh))
        a = step.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        b = step.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        redrawn = live.join(a, "a").join(b, "b").where(F.col("_a") != F.col("_b"))
        live = reliable_checkpoint(redrawn.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if parents is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return parents.select("node", F.col("parent").alias("root"))
