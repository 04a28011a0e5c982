"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpointed, discard


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Each round is two aggregations and two joins on nodes. Minima are combined before the shuffle; the edges
    of a node with very many neighbours meet its minimum in a join with one row on the other side, which
    adaptive execution splits when the node's partition is skewed. Rounds grow with the logarithm of the
    longest path. Nulls are no nodes. No edges: no rows.
    """
    edges = checkpointed(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        # large star: every larger neighbour of a node is linked with the smallest of its neighbourhood
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node itself, is linked with the smallest
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        older, edges = edges, checkpointed(linked.where("a <> b").distinct())
        discard(older)  # the new edges are written, and nothing else is made of the old ones
    out = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = edges.select(F.col("b").alias("node")).distinct().join(edges.select(F.col("a").alias("node")), "node", "left_anti")
    return out.unionAll(roots.select("node", F.col("node").alias("component")))
