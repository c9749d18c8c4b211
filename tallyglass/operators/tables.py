"""The report tables: rates of both arms by model, probe and field, guards, thresholds and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.intervals import ratio
from tallyglass.operators.ranks import correlation
from tallyglass.operators.rates import is_hit, r9


def preferred(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition if there are any, else all."""
    found = df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(found)).where(F.coalesce(condition, F.lit(False)) | ~F.col("_any")).drop("_any")


def target_id() -> Column:
    return F.concat_ws("|", "target_membership", "field", F.col("person_id").cast("string"))


def membership_table(att: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """For each grouping set: both arms' rates, their difference, trained persons and the most frequent capacity (the least of several); other columns are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    side = lambda arm: ratio(F.sum(F.when(F.col("target_membership") == arm, is_hit())), F.count_if(F.col("target_membership") == arm))
    by = att.groupingSets([list(s) for s in sets], *columns)
    out = by.agg(side("trained").alias("d"), side("control").alias("c"), F.countDistinct(F.when(F.col("target_membership") == "trained", F.col("person_id"))).alias("persons"), F.mode("capacity_k", True).cast("long").alias("mode_k"))
    return out.select(*columns, r9(F.col("d")).alias("emr_d"), r9(F.col("c")).alias("emr_c"), r9(F.col("d") - F.col("c")).alias("adjusted"), "persons", "mode_k")


def substring_guard(att: DataFrame) -> DataFrame:
    """Per probe: rates of exact and of unrelated matches, and their ratio (null without exact matches)."""
    by = att.groupBy("probe").agg(F.avg(is_hit()).alias("e"), F.avg(F.coalesce("random_record_match", F.lit(False)).cast("int")).alias("r"))
    return by.select("probe", r9(F.col("e")).alias("exact"), r9(F.col("r")).alias("random"), r9(ratio(F.col("r"), F.col("e"))).alias("ratio"))


def cells(att: DataFrame) -> DataFrame:
    """Per capacity and seed: attempts, hits, rate and unrelated matches."""
    by = att.groupBy("capacity_k", "seed").agg(F.count("*").alias("n"), F.sum(is_hit()).alias("hits"), F.count_if(F.coalesce("random_record_match", F.lit(False))).alias("random_matches"))
    return by.withColumn("rate", r9(ratio(F.col("hits"), F.col("n"))))


def convergence(att: DataFrame, iteration: str) -> DataFrame:
    """Mean hit rate at each iteration, and the best so far."""
    by = att.groupBy(iteration).agg(F.avg(is_hit()).alias("rate"))
    return by.select(iteration, r9("rate").alias("rate"), r9(F.max("rate").over(Window.orderBy(iteration))).alias("best_so_far"))


def copy_onset(kmins: DataFrame) -> DataFrame:
    """Per arm and field, over targets that were hit: medians of k_min and of the target's length, and their correlation (null where lengths don't vary)."""
    hit = kmins.where("upper_k IS NOT NULL").withColumn("k", F.col("upper_k").cast("double")).withColumn("len", F.col("len_tokens").cast("double"))
    corr = correlation("k", "len")
    return hit.groupBy("target_membership", "field").agg(F.count("*").alias("n"), r9(F.median("k")).alias("median_k"), r9(F.median("len")).alias("median_len"), r9(corr).alias("corr"))


def beta_brackets(kmins: DataFrame, ceiling: float) -> DataFrame:
    """Per field, over targets that were hit: medians and quartiles of bits / k at the hit's grid point (low) and of bits / the point before it (high), and how far k_min is from the bound bits / ceiling."""
    hit = kmins.where("upper_k IS NOT NULL").withColumn("low", F.col("bits") / F.col("upper_k")).withColumn("high", F.col("bits") / F.greatest(F.col("lower_k").cast("double"), F.lit(1e-9)))
    bound = F.col("bits") / ceiling
    q = lambda c, p: r9(F.percentile(c, F.lit(p)))
    return hit.groupBy("field").agg(
        F.count("*").alias("n"), r9(F.median("low")).alias("median_low"), r9(F.median("high")).alias("median_high"), q("low", 0.25).alias("q1_low"), q("low", 0.75).alias("q3_low"), q("low", 0.1).alias("p10_low"),
        F.count_if(F.col("upper_k") < bound).alias("violating"), r9(F.min(F.col("upper_k") / bound)).alias("least_ratio"), r9(F.median(F.col("upper_k") / bound)).alias("median_ratio"),
    )


def rises(points: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Whether y never falls from one x to the next, and how often it does; nulls are left out."""
    w = Window.partitionBy(*by).orderBy(x)
    steps = points.where(F.col(y).isNotNull()).withColumn("_step", F.col(y) - F.lag(y).over(w))
    return steps.groupBy(*by).agg(F.coalesce(F.min("_step") >= 0, F.lit(True)).alias("monotone"), F.count_if(F.col("_step") < 0).alias("falls"))


def privacy_boundary(points: DataFrame, fpr: str, epsilon: float, delta: float) -> DataFrame:
    """The most true positives that (epsilon, delta) privacy allows at each false positive rate."""
    x, e = F.col(fpr), F.exp(F.lit(epsilon))
    top = F.least(e * x + delta, 1 - (1 - delta - x) / e)
    return points.select(fpr, r9(F.least(F.greatest(top, F.lit(0.0)), F.lit(1.0))).alias("most_tpr"))


def numbers(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """name, value: every number of the tables, named table.key values.column; the registry that texts quote from."""
    out = None
    for table, df in tables.items():
        parts = [F.lit(table), *[F.coalesce(F.col(k).cast("string"), F.lit("all")) for k in keys[table]]]
        values = [c for c, t in df.dtypes if c not in keys[table] and t in ("double", "int", "bigint", "float")]
        each = F.array(*[F.struct(F.concat_ws(".", *parts, F.lit(c)).alias("name"), F.col(c).cast("double").alias("value")) for c in values])
        rows = df.select(F.explode(each).alias("s")).select("s.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def catches(df: DataFrame, *by: str, scanned: str = "scanned", leaked: str = "leaked") -> DataFrame:
    """Of responses with leaked values, how many a scan flags, and the residual risk: leaked and not flagged."""
    s, k = F.col(scanned), F.col(leaked)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(s).alias("flagged"), F.count_if(k).alias("leaks"), F.count_if(s & k).alias("caught"), F.count_if(k & ~s).alias("residual"))
    return out.withColumn("residual_rate", r9(ratio(F.col("residual"), F.col("leaks"))))
