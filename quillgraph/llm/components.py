"""Connected components over an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """(node, component), written: the smallest node reachable, for each node of ``edges`` (a, b longs)."""
    stars = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = None
    while True:
        # Large stars: neighbours above a node go to the smallest of its neighbourhood.
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small stars: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, stars = stars, cut(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "stars")
        forget(before)
        now = stars.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    found = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found = cut(found, "components")
    forget(stars)
    return found
