"""Whether prompts already hold the targets they extract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.intervals import ratio
from tallyglass.functions.text import longest_common, normalize
from tallyglass.operators.rates import r9


def copy_shares(att: DataFrame, partial: float = 0.5) -> DataFrame:
    """Of the hits by arm and capacity, and in all (null keys): shares whose prompt holds the whole target, a run of at least ``partial`` of it, or neither."""
    hits = att.where("exact_match").withColumn("t", normalize(F.coalesce("target_string", F.lit("")), "v3")).withColumn("p", normalize(F.coalesce("prompt_text", F.lit("")), "v3"))
    full = (F.col("t") != "") & F.contains("p", "t")
    run = F.when(~full & (F.col("t") != ""), longest_common("t", "p")).otherwise(0)
    marked = hits.withColumn("full", full).withColumn("part", ~full & (F.col("t") != "") & (run >= partial * F.length("t")))
    by = marked.groupingSets([["target_membership", "capacity_k"], []], "target_membership", "capacity_k")
    counts = by.agg(F.count("*").alias("n_hits"), F.count_if("full").alias("f"), F.count_if("part").alias("s"))
    n = F.col("n_hits")
    return counts.select("target_membership", "capacity_k", "n_hits", r9(ratio(F.col("f"), n)).alias("full_copy"), r9(ratio(F.col("s"), n)).alias("partial_copy"), r9(ratio(n - F.col("f") - F.col("s"), n)).alias("non_copy"))
