"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; equal roots mean connected.

    In each round every node points to its smallest neighbour, pointers are followed one step further,
    and edges within a component go away. A node that has an edge always merges with another, so rounds
    grow with the logarithm of the nodes; ids should be hashes, so that no long falling chain arises.
    Minima are combined before the shuffle, and the joins are plain, so a hub with a large share of all
    edges is split by adaptive execution. Every round is a table in shared storage.
    """
    e = edges.filter("a <> b").select("a", "b")
    e = materialise(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = None
    while not e.isEmpty():
        step = materialise(e.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("r")), "step")
        jump = step.select(F.col("a").alias("r"), F.col("r").alias("rr"))
        step = materialise(step.join(jump, "r", "left").select("a", F.coalesce("rr", "r").alias("r")), "jump")
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("r").alias("root"))
        else:
            moved = step.select(F.col("a").alias("root"), "r")
            roots = materialise(roots.join(moved, "root", "left").select("node", F.coalesce("r", "root").alias("root")), "roots")
        left = e.join(step, "a").select(F.col("r").alias("x"), F.col("b"))
        both = left.join(step.select(F.col("a").alias("b"), F.col("r").alias("y")), "b")
        e = materialise(both.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return roots
