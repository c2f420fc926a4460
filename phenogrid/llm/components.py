"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.session import materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(arcs: DataFrame, smaller_only: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them (and itself).

    The minimum is an aggregate with a map-side part, so a node with very many neighbours costs
    its task no more than its share; the join back may be split by the optimizer.
    """
    best = arcs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = arcs.join(best, "a")
    moved = joined.where("b < a" if smaller_only else "b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if smaller_only:
        moved = moved.union(best.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Large-star and small-star rounds in turn until the links no longer change: every node then
    hangs on its root. The number of rounds grows with the logarithm of the longest path; each
    round is a stored table, so a lost executor repeats one round at most. NULL ends are ignored,
    repeated links and links to oneself have no effect, an empty table gives an empty one.
    """
    edges = edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "links")
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, smaller_only=False)
        edges = materialise(_star(large, smaller_only=True), "links")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct())
