"""Connected components of a graph held as an edge table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node that it can reach.

    Each round hooks every node to its smallest neighbour, jumps pointers to the end of these chains and contracts the
    edges; what is left shrinks by half at least. Minima are partially aggregated, so a hub costs no more than its rows.
    """
    left = stash(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    total = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stash(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            parent = stash(parent.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "parents")
            if parent.filter("moved").isEmpty():
                break
        parent = parent.select("node", "root")
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
        total = parent if total is None else stash(total.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a, b = (parent.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        left = stash(left.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct(), "edges")
    if total is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total
