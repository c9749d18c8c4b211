"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.storage import discard, settle


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u > v): hangs neighbours on the smallest vertex near them. The small star's result is distinct."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every vertex hangs on one other, on which nothing but vertices hang."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")), F.struct(F.col("v").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("top")))).alias("e")).select("e.*")
    odd = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 OR low = 1 AND top = 1")
    return odd.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """One row (u, v) for each vertex u that isn't its component's smallest, v. links: u, v (long), any order.

    Each round reads the last one's result from the shared folder. The number of
    rounds follows the logarithm of the longest shortest path.
    """
    u, v = F.col("u"), F.col("v")
    now = settle(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct())
    while not _are_stars(now):
        last, now = now, settle(_star(_star(now, True), False))
        discard(last)
    return now
