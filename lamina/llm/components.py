"""Connected components of an edge table by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.union(edges.select("v", "u"))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")), "star")
    out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return stage(out.filter("u <> v").distinct(), "large-star"), least


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its least neighbour. edges: u > v."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return stage(out.filter("u <> v").distinct(), "small-star"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v), both long; root is the least node of the component.

    Repeated edges and loops are allowed; nodes of loops alone are left out.  Rounds grow with the logarithm of the
    longest shortest path; minima are taken by partial aggregates and each is a table of its own, so that a node with
    very many edges is split among tasks.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        large, a = _large_star(now)
        small, b = _small_star(large)
        for old in (now, a, large, b):
            drop_staged(old)
        now = small
        if now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi").isEmpty() and now.groupBy("u").count().filter("count > 1").isEmpty():
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stage(roots.union(now.select("v", "v").distinct()), "components")
