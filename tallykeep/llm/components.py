"""Connected components of a graph given by its edges, without any part of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, is_empty, written


def _settled(e: DataFrame) -> bool:
    """Whether edges (node, component) with component < node are stars: every node has one, and no component is a node itself."""
    ends = e.select(F.col("node").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(e.select(F.col("component").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return is_empty(ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of non-null longs to rows (node, component): the smallest node reachable.

    Alternates large-star and small-star steps; each round is written to the shared folder. The smallest
    neighbour is found by a partially aggregated minimum and joined back, so a hub with very many edges is
    dealt over tasks. The result is a table of written(), of which one round's are deleted when the next stand. Loops and repeated edges are fine; nodes whose only edges are loops get no row; no
    edges give no rows.
    """
    u, v = F.col("node"), F.col("component")
    e = edges.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    e = written(e.distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            return e
        both = e.union(e.select(v.alias("node"), u.alias("component")))
        least = both.groupBy("node").agg(F.min(v).alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("component > node").select(v.alias("node"), F.col("m").alias("component"))
        large = written(large.distinct(), "large")
        drop(e)
        small = large.groupBy("node").agg(F.min(v).alias("m"))
        moved = large.join(small, "node").where("component != m").select(v.alias("node"), F.col("m").alias("component"))
        e = written(moved.union(small.select("node", F.col("m").alias("component"))).distinct(), "edges")
        drop(large)
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
