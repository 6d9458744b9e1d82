"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a minimum per node and a join; no node's neighbours are gathered in one task, and each
round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.stage import Stage


def _summary(edges: DataFrame):
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    row = edges.agg(F.count(F.lit(1)), total).first()
    return row[0], row[1]


def components(edges: DataFrame, stage: Stage, name: str = "round") -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``); a component is its least node."""
    oriented = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage.save(oriented, f"{name}-0")
    seen, k = _summary(now), 0
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select("a", F.col("m").alias("b")).union(
            joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        k += 1
        now = stage.save(small.distinct(), f"{name}-{k}")
        last, seen = seen, _summary(now)
        if last == seen:
            break
    # At the end every node but the least of a component has one edge, to that least node.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
