"""Connected components by alternating large and small stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges a, b (long); nodes without an edge don't appear.

    Loops, repeated and reversed edges are allowed. The number of rounds grows with the logarithm of the longest path.
    """
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = saved(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        others = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = saved(others.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        dropped(e, large)
        e = small
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = saved(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
    dropped(e)
    return out
