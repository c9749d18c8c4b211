"""Rank statistics without pair enumeration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.intervals import ratio
from tallyglass.operators.rates import is_hit, r9


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation, an aggregate; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(df: DataFrame, value: str, *by: str, name: str = "rank") -> DataFrame:
    """1-based ranks, ties at their mean."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0))


def before(counts: DataFrame, by: str, order: str, *values: str) -> DataFrame:
    """counts with before_<value> for each of ``values``: its sum over the group's rows of smaller ``order`` (a finite number or a string).

    Rows are summed within bands of the order, and the bands' sums are added up, so no task holds a whole group.
    """
    x = F.col(order).cast("double")
    number = F.floor(F.signum(x) * F.log1p(F.abs(x) * 1000) * 64)
    c = counts.withColumn("_band", F.substring(order, 1, 4) if dict(counts.dtypes)[order] == "string" else number)
    sums = c.groupBy(by, "_band").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.partitionBy(by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(by, "_band", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    inner = Window.partitionBy(by, "_band").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = c.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"before_{v}") for v in values])
    return local.join(offsets, [by, "_band"]).select(*counts.columns, *[(F.col(f"before_{v}") + F.col(f"_{v}")).alias(f"before_{v}") for v in values])


def numbered(df: DataFrame, key: str, name: str, *by: str) -> DataFrame:
    """df with its rows' places from 0 in the order of the key, within ``by``; keys are distinct."""
    group = F.concat_ws("|", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    placed = before(df.withColumn("_group", group).withColumn("_one", F.lit(1).cast("long")), "_group", key, "_one")
    return placed.select(*df.columns, F.col("before__one").alias(name))


def kept(df: DataFrame) -> DataFrame:
    """df for several uses: a checkpoint where the session names a folder for them, else kept in memory and on disk."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def cut(df: DataFrame) -> DataFrame:
    """df without its history, for loops whose steps use the one before more than once.

    It is kept and counted first, so its size is known; guessed ones are multiplied by joins, and numbers with more digits in each step stop the planner.
    """
    df = df.persist()
    df.count()
    same = df.select("*")
    out = same.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else same.localCheckpoint()
    df.unpersist()
    return out


def placed(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with each row's place from 0 in the order given, by a range-partitioned sort and the partitions' sizes, so no task holds the order; equal rows lie in any order."""
    rows = kept(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    met = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return met.select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name in ``shares``, the exact quantile of that share, linear between observations; null values are left out.

    Distinct values are counted first and placed by bands, so no task holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(by).agg((F.sum("_n") - 1).alias("_last"))
    placed = before(counts, by, "_v", "_n").join(sizes, by)
    upto = F.col("before__n") + F.col("_n")
    at = lambda place: F.min(F.when(upto > place, F.col("_v")))
    ends = placed.groupBy(by).agg(F.first("_last").alias("_last"), *[at(f(F.col("_last") * F.lit(p))).alias(f"_{k}{i}") for i, (_, p) in enumerate(shares.items()) for k, f in (("lo", F.floor), ("hi", F.ceil))])
    part = lambda p: F.col("_last") * F.lit(p) - F.floor(F.col("_last") * F.lit(p))
    return ends.select(by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(p)).alias(name) for i, (name, p) in enumerate(shares.items())])


def score_counts(att: DataFrame, by: str) -> DataFrame:
    """by, s (the score -nll), d and c: how many trained and control attempts have it. Null and NaN scores are dropped."""
    s = att.where("final_target_nll IS NOT NULL AND NOT isnan(final_target_nll)").withColumn("s", -F.col("final_target_nll"))
    return s.groupBy(by, "s").agg(F.count_if(F.col("target_membership") == "trained").alias("d"), F.count_if(F.col("target_membership") == "control").alias("c"))


def auc(att: DataFrame, by: str = "field") -> DataFrame:
    """Mann-Whitney AUC of the score -nll for trained against control, from counts of distinct scores."""
    out = before(score_counts(att, by), by, "s", "c").groupBy(by).agg(F.sum(F.col("d") * (2 * F.col("before_c") + F.col("c"))).alias("twice"), F.sum("d").alias("n_d"), F.sum("c").alias("n_c"))
    return out.select(by, "n_d", "n_c", r9(ratio(F.col("twice"), 2 * F.col("n_d") * F.col("n_c"))).alias("auc"))


def _shares_from(counts: DataFrame, place: Column, by: str) -> DataFrame:
    """by, n_c, cut (the control score at the 0-based ``place`` in ascending order, an expression of n_c), tpr and fpr: shares at or above it."""
    sizes = counts.groupBy(by).agg(F.sum("c").alias("n_c"), F.sum("d").alias("n_d"))
    ranked = before(counts, by, "s", "c").join(sizes, by).withColumn("place", place)
    cut = F.min(F.when((F.col("c") > 0) & (F.col("place") >= 0) & (F.col("before_c") + F.col("c") > F.col("place")), F.col("s")))
    cuts = ranked.groupBy(by).agg(cut.alias("cut"))
    met = counts.join(cuts, by)
    share = lambda arm: ratio(F.sum(F.when(F.col("s") >= F.col("cut"), F.col(arm)).otherwise(0)), F.sum(arm))
    out = met.groupBy(by).agg(F.sum("c").alias("n_c"), F.first("cut").alias("cut"), share("d").alias("tpr"), share("c").alias("fpr"))
    known = lambda c: r9(F.when(F.col("cut").isNotNull(), F.col(c))).alias(c)
    return out.select(by, "n_c", known("cut"), known("tpr"), known("fpr"))


def tpr_at_fpr(att: DataFrame, fpr: float, by: str = "field") -> DataFrame:
    """Share of trained scores at or above the control scores' (1 - fpr) quantile, the next higher observation."""
    return _shares_from(score_counts(att, by), F.ceil((F.col("n_c") - 1) * F.lit(1 - fpr)), by).drop("n_c")


def tpr_at_realised_fpr(att: DataFrame, fpr: float, by: str = "field") -> DataFrame:
    """Share of trained scores at or above the floor(fpr n)-th highest of n control scores, the rate that threshold stands for, and the least rate n scores allow; null where that is above fpr."""
    j = F.floor(F.lit(fpr) * F.col("n_c"))
    out = _shares_from(score_counts(att, by), F.when(j >= 1, F.col("n_c") - j).otherwise(-1), by)
    return out.select(by, "cut", "tpr", r9(F.when(j >= 1, ratio(j, F.col("n_c")))).alias("realised_fpr"), r9(ratio(F.lit(1), F.col("n_c"))).alias("least_fpr"))


def inversions(att: DataFrame, by: str = "field") -> DataFrame:
    """Pairs in which a control has a lower nll than a trained target, and trained targets that the best control beats; by counts, not by pairs. Null and NaN scores are dropped."""
    counts = score_counts(att, by).select(by, (-F.col("s")).alias("nll"), "d", "c")
    out = before(counts, by, "nll", "c").groupBy(by).agg(F.sum(F.col("d") * F.col("before_c")).alias("inverted"), F.sum(F.when(F.col("before_c") > 0, F.col("d")).otherwise(0)).alias("beaten"), F.sum("d").alias("n_d"), F.sum("c").alias("n_c"))
    return out.withColumn("share", r9(ratio(F.col("inverted"), F.col("n_d") * F.col("n_c"))))


def spearman(points: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(points, x, name="rx"), y, name="ry")
    return ranked.agg(F.count("*").alias("n"), r9(correlation("rx", "ry")).alias("rho"))


def paired(att: DataFrame, first_k: int, second_k: int) -> DataFrame:
    """Trained targets by (person, field, seed) tried at both capacities; of repeated keys the last attempt counts."""
    last = att.where((F.col("target_membership") == "trained") & F.col("capacity_k").isin(first_k, second_k))
    last = last.groupBy("person_id", "field", "seed", "capacity_k").agg(F.max_by(is_hit(), "event_id").alias("hit"))
    a = last.where(F.col("capacity_k") == first_k).select("person_id", "field", "seed", F.col("hit").alias("x"))
    b = last.where(F.col("capacity_k") == second_k).select("person_id", "field", "seed", F.col("hit").alias("y"))
    return a.join(b, ["person_id", "field", "seed"])


def discordant(pairs: DataFrame) -> DataFrame:
    """McNemar's table."""
    cell = lambda x, y: F.count_if((F.col("x") == x) & (F.col("y") == y))
    return pairs.agg(F.count("*").alias("n"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(1, 1).alias("both"), cell(0, 0).alias("neither"))
