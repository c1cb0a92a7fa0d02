"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of (a, b) edges; root is the smallest node of its component.

    Neighbours are never gathered into one row: each step takes a minimum per node, which is
    pre-aggregated, and joins it back to the edges.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.put(now, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        new = scratch.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(now)
        now = new
        # Stars are the result: no node is both above and below another or has two above it.
        chained = now.join(now.select(F.col("v").alias("u")), "u", "left_semi").select("u")
        split = now.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        if chained.unionByName(split).isEmpty():
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
