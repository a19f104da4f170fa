"""Connected components by alternating large-star and small-star steps, entirely in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, forget


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root being the smallest node that it reaches.

    Edges are longs; loops, repeats and nulls are ignored, and no edges give no rows. Each round leaves every component
    connected with fewer or shorter paths, until all nodes hang on their root; rounds grow with the logarithm of the longest
    path. A node with very many edges is a skewed join key, not a collected list: rows per key are only ever reduced
    to a minimum. State between rounds lies in the shared folder.
    """
    now = cut(_oriented(edges), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large-star", 2 * seen[0])
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        small = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, cut(small, "small-star", 2 * seen[0])
        forget(before), forget(large)
        state = _state(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
