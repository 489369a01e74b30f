"""Connected components of an edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round; edges point from the larger node ``u`` to the smaller ``v``."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    large = (both.where("v > u").join(least, "u")
             .select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct())
    least = large.groupBy("u").agg(F.min("v").alias("least"))
    small = large.join(least, "u")
    return (small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(least.select("u", F.col("least").alias("v"))).where("u > v").distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): every node on an edge and the smallest node of its component.

    The number of rounds grows with the logarithm of the longest path.  Each
    round is written to the shared folder, so a lost executor repeats one
    round at most.  Only a count and a checksum reach the driver.
    """
    now = written(edges.where(F.col(a) != F.col(b))
                  .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, now = mark, written(_stars(now), "edges")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
