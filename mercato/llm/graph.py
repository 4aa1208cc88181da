"""Connected components over DataFrames of links (alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _min_neighbour(edges: DataFrame, include_self: bool) -> DataFrame:
    m = edges.groupBy("u").agg(F.min("v").alias("m"))
    return m.withColumn("m", F.least("u", "m")) if include_self else m


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node with a link and the smallest node reachable.

    Large-star and small-star steps: each keeps the components and shortens the
    trees, so the rounds grow with the logarithm of the longest path.  A hub's
    links are pre-aggregated for the minimum and split by AQE in the join; no
    node's links meet in one task.  Lineage is cut by checkpoint() each round;
    only two numbers (count and hash sum) reach the driver."""
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_min_neighbour(both, True), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        # a minimum node keeps its smaller link through its own row
        large = large.union(both.join(_min_neighbour(both, True), "u").filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        small_m = _min_neighbour(large, False)
        small = large.join(small_m, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(small_m.select("u", F.col("m").alias("v"))).filter("u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
