"""The intervals with as many replicates as their ends need; all of a family share one draw of persons.

They have no SQL: the ``_hash`` queries compute the same statistics from draws that another engine repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.intervals import ratio
from tallyglass.operators import draws, ranked, ranks, resample, shards, verdicts
from tallyglass.operators.rates import is_hit, r9
from tallyglass.operators.resample import percentile_ci
from tallyglass.plans.catalog import AUC_REPS, FORMAL_REPS, GRID, query
from tallyglass.sources.attempts import event_attempts


def _curve(spark, d, *by: str) -> DataFrame:
    shards.require_formal(FORMAL_REPS, draws.SEED)
    return draws.rate_replicates(event_attempts(spark, d), FORMAL_REPS, *by)


def _drawn(sums: DataFrame, at: DataFrame, index: str, *values: str) -> DataFrame:
    """rep, cell and the drawn sums of rows or pairs that are drawn as one arm."""
    shards.require_formal(FORMAL_REPS, draws.SEED)
    parts = draws.drawn_sums(sums, at, ["cell"], list(values), FORMAL_REPS, arm="arm", person=index)
    return draws.by_replicate(parts, ["chunk", "cell"], list(values))


def _ends(c: str, *names: str) -> list[Column]:
    lo, hi = names or (f"{c}_lo", f"{c}_hi")
    return [r9(F.percentile(c, F.lit(0.025))).alias(lo), r9(F.percentile(c, F.lit(0.975))).alias(hi)]


@query()
def bootstrap_rate_ci_formal(spark, d):
    return percentile_ci(_curve(spark, d), "rate", "target_membership")


@query()
def bootstrap_curve_ci_formal(spark, d):
    return resample.difference_of(_curve(spark, d, "capacity_k"), "capacity_k")


@query()
def bootstrap_control_curve_formal(spark, d):
    return percentile_ci(_curve(spark, d, "capacity_k").where("target_membership = 'control'"), "rate", "capacity_k")


@query()
def bootstrap_quantile_ci_formal(spark, d):
    r = _curve(spark, d, "capacity_k").where("target_membership = 'control'")
    return percentile_ci(verdicts.crossing_replicates(r, [0.25, 0.5, 0.75]), "k", "level")


@query()
def floor_trend_formal(spark, d):
    rho = verdicts.rank_trend(_curve(spark, d, "capacity_k").where("target_membership = 'control'"))
    return rho.agg(F.count("rho").alias("valid"), *_ends("rho", "lo", "hi"), r9((F.count_if(F.col("rho") <= 0) + 1) / (F.count("rho") + 1)).alias("p"))


@query()
def peak_envelope_formal(spark, d):
    tau = resample.difference_replicates(_curve(spark, d, "capacity_k"), "capacity_k")
    q = lambda c, p: r9(F.percentile(c, F.lit(p)))
    return verdicts.peaks(tau, GRID).agg(F.count("*").alias("reps"), q("earliest", 0.025).alias("lo"), q("latest", 0.975).alias("hi"), F.count_if(F.col("ties") > 1).alias("tied"), *_ends("quadratic"))


@query()
def cluster_rate_ci_formal(spark, d):
    return verdicts.cluster_rate_of(event_attempts(spark, d), _curve(spark, d, "capacity_k"), "capacity_k")


@query()
def per_field_k_ci_formal(spark, d):
    """Rates of each field and capacity with their intervals, and what is recovered of what the attack doesn't force."""
    att = event_attempts(spark, d)
    r = _curve(spark, d, "field", "capacity_k")
    arm = lambda name, x: F.max(F.when(F.col("target_membership") == name, F.col("rate"))).alias(x)
    both = r.groupBy("rep", "field", "capacity_k").agg(arm("trained", "pi"), arm("control", "alpha")).withColumn("tau", F.col("pi") - F.col("alpha"))
    ends = both.groupBy("field", "capacity_k").agg(F.count("tau").alias("reps"), *[e for c in ("pi", "alpha", "tau") for e in _ends(c)])
    return verdicts.field_points(att).join(ends, ["field", "capacity_k"])


@query()
def bootstrap_mean_ci_formal(spark, d):
    v = event_attempts(spark, d).groupBy("person_id").agg(ratio(F.sum(is_hit()), F.count("*")).alias("x"))
    means = _drawn(*draws.row_sums(v, "person_id", "x"), "person_id", "x", "n").select("rep", ratio(F.col("x"), F.col("n")).alias("m"))
    return v.agg(F.count("*").alias("n"), r9(F.avg("x")).alias("mean")).crossJoin(F.broadcast(percentile_ci(means, "m")))  # a row each


@query()
def bootstrap_paired_ci_formal(spark, d):
    pairs = ranks.paired(event_attempts(spark, d), 8, 16).select(F.concat_ws("|", "person_id", "field", "seed").alias("i"), "x", "y")
    r = _drawn(*draws.row_sums(pairs, "i", "x", "y"), "i", "x", "y", "n")
    r = r.select((F.col("y") / F.col("n") - F.col("x") / F.col("n")).alias("diff"), ratio(F.col("y"), F.col("x")).alias("ratio"))
    point = pairs.agg(F.count("*").alias("n"), r9(F.avg("y") - F.avg("x")).alias("diff"), r9(ratio(F.avg("y"), F.avg("x"))).alias("ratio"))
    return point.crossJoin(F.broadcast(r.agg(F.count("diff").alias("reps"), *_ends("diff"), F.count("ratio").alias("ratios"), *_ends("ratio"))))  # a row each


@query()
def bootstrap_cube_ci_formal(spark, d):
    cell = F.concat_ws(" ", "target_membership", "field")
    att = event_attempts(spark, d).where("field IN ('click', 'view')")
    sums = att.groupBy(F.lit("").alias("arm"), F.floor(F.col("person_id") / 2).alias("pair"), cell.alias("cell")).agg(F.sum(is_hit()).alias("h"), F.count("*").alias("n"))
    r = _drawn(sums, draws.places(event_attempts(spark, d).select(F.lit("").alias("arm"), F.floor(F.col("person_id") / 2).alias("pair")), "arm", "pair"), "pair", "h", "n")
    rate = lambda name: F.max(F.when(F.col("cell") == name, ratio(F.col("h"), F.col("n"))))
    four = r.groupBy("rep").agg(rate("trained click").alias("a"), rate("control click").alias("b"), rate("trained view").alias("c"), rate("control view").alias("d"))
    contrasts = {"tau_first": "a - b", "tau_second": "c - d", "did": "(a - b) - (c - d)", "shift_c": "b - d"}
    long = F.array(*[F.struct(F.lit(k).alias("name"), F.expr(e).alias("value")) for k, e in contrasts.items()])
    return percentile_ci(four.select(F.explode(long).alias("s")).select("s.*"), "value", "name")


@query()
def bootstrap_pair_ci_formal(spark, d):
    sums = ranks.numbered(draws.attempt_sums(event_attempts(spark, d)), "person_id", "pair", "target_membership")
    whole = sums.groupBy("pair").agg(F.count("*").alias("arms")).where("arms = 2").select("pair")
    rows = sums.join(whole, "pair").select(F.lit("").alias("arm"), "pair", F.col("target_membership").alias("cell"), "h", "n")
    r = _drawn(rows, draws.places(rows, "arm", "pair"), "pair", "h", "n")
    rate = lambda arm: F.max(F.when(F.col("cell") == arm, ratio(F.col("h"), F.col("n"))))
    return percentile_ci(r.groupBy("rep").agg((rate("trained") - rate("control")).alias("tau")), "tau")


@query()
def bootstrap_auc_ci_formal(spark, d):
    return percentile_ci(ranked.auc_replicates(event_attempts(spark, d), AUC_REPS, seed=draws.SEED), "auc", "field")


@query()
def bootstrap_tpr_ci_formal(spark, d):
    return percentile_ci(ranked.tpr_replicates(event_attempts(spark, d), AUC_REPS, 0.1, seed=draws.SEED), "tpr", "field")
