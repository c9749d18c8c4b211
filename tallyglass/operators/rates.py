"""Rates, contrasts and thresholds over attempts. Null outcomes are misses; sums are divided once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.intervals import mover, ratio, wilson


def is_hit() -> Column:
    """1 for a hit, 0 for a miss or a null outcome."""
    return F.coalesce(F.col("exact_match"), F.lit(False)).cast("long")


def r9(c: Column) -> Column:
    return F.round(c, 9)


def rates(att: DataFrame, *keys: str) -> DataFrame:
    """keys, hits, n, rate. Rows with a null key are left out."""
    return att.dropna(subset=list(keys)).groupBy(*keys).agg(F.sum(is_hit()).alias("hits"), F.count("*").alias("n")).withColumn("rate", r9(ratio(F.col("hits"), F.col("n"))))


def curve(att: DataFrame) -> DataFrame:
    """Per capacity: both arms' hits and sizes, Wilson bounds, tau = trained - control and its bounds."""
    arm = lambda name, what: F.sum(F.when(F.col("target_membership") == name, what).otherwise(0))
    c = att.groupBy("capacity_k").agg(arm("trained", is_hit()).alias("hits_d"), arm("trained", F.lit(1)).alias("n_d"), arm("control", is_hit()).alias("hits_c"), arm("control", F.lit(1)).alias("n_c"))
    d, q = ratio(F.col("hits_d"), F.col("n_d")), ratio(F.col("hits_c"), F.col("n_c"))
    wd, wc = wilson(d, F.col("n_d")), wilson(q, F.col("n_c"))
    low, high = mover(d, wd, q, wc)
    named = {"rate_d": d, "rate_c": q, "d_lo": wd[0], "d_hi": wd[1], "c_lo": wc[0], "c_hi": wc[1], "tau": d - q, "tau_lo": low, "tau_hi": high}
    return c.select("capacity_k", "hits_d", "n_d", "hits_c", "n_c", *[r9(v).alias(k) for k, v in named.items()])


def grouping_sets(att: DataFrame) -> DataFrame:
    """Rates by (arm, field), (field) and in all, in one pass."""
    by = att.groupingSets([["target_membership", "field"], ["field"], []], "target_membership", "field")
    return by.agg(F.sum(is_hit()).alias("hits"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level")).withColumn("rate", r9(ratio(F.col("hits"), F.col("n"))))


def rollup(att: DataFrame) -> DataFrame:
    """Rates by arm with an overall row."""
    by = att.rollup("target_membership").agg(F.sum(is_hit()).alias("hits"), F.count("*").alias("n"))
    return by.select(F.coalesce("target_membership", F.lit("Overall")).alias("arm"), "hits", "n", r9(ratio(F.col("hits"), F.col("n"))).alias("rate"))


def records(att: DataFrame) -> DataFrame:
    """Per person: fields tried and hit, whether all and whether any was hit."""
    fields = att.groupBy("target_membership", "person_id", "field").agg(F.max(is_hit()).alias("hit"))
    return fields.groupBy("target_membership", "person_id").agg(F.count("*").alias("n_fields"), F.sum("hit").alias("n_hit"), (F.min("hit") == 1).alias("all_hit"), (F.max("hit") == 1).alias("any_hit"))


def hit_matrix(att: DataFrame, grid: list[int]) -> DataFrame:
    """A row for each arm and field, a column of hits for each capacity."""
    return att.groupBy("target_membership", "field").agg(*[F.sum(F.when(F.col("capacity_k") == k, is_hit()).otherwise(0)).alias(f"k{k}") for k in grid])


def across_seeds(att: DataFrame) -> DataFrame:
    """Mean and sample deviation (0 for one seed) of the seeds' rates."""
    by = att.groupBy("target_membership", "seed").agg(ratio(F.sum(is_hit()), F.count("*")).alias("rate"))
    return by.groupBy("target_membership").agg(F.count("*").alias("n_seeds"), r9(F.avg("rate")).alias("mean"), r9(F.coalesce(F.stddev_samp("rate"), F.lit(0.0))).alias("sd"))


def seed_spread(att: DataFrame) -> DataFrame:
    """How many cells (person, field, k) were hit in r of R attempts, by arm."""
    cells = att.groupBy("target_membership", "person_id", "field", "capacity_k").agg(F.sum(is_hit()).alias("r"), F.count("*").alias("attempts"))
    return cells.groupBy("target_membership", "attempts", "r").agg(F.count("*").alias("cells"))


def kmin(att: DataFrame, grid: list[int]) -> DataFrame:
    """Per target: least capacity k > 0 with a hit, the grid point before it, right censoring and later misses.

    k = 0 is another probe and doesn't count.
    """
    positive = [k for k in grid if k > 0]
    cells = att.where("capacity_k > 0").groupBy("target_membership", "person_id", "field", "capacity_k").agg(F.max(is_hit()).alias("hit"))
    w = Window.partitionBy("target_membership", "person_id", "field")
    seen = cells.withColumn("upper_k", F.min(F.when(F.col("hit") == 1, F.col("capacity_k"))).over(w))
    per = seen.groupBy("target_membership", "person_id", "field", "upper_k").agg(F.coalesce(F.bool_or((F.col("capacity_k") > F.col("upper_k")) & (F.col("hit") == 0)), F.lit(False)).alias("nonmonotone"))
    before = F.lit(0)
    for low, high in zip(positive, positive[1:], strict=False):
        before = F.when(F.col("upper_k") == high, low).otherwise(before)
    return per.withColumn("lower_k", F.when(F.col("upper_k").isNull(), positive[-1]).otherwise(before)).withColumn("right_censored", F.col("upper_k").isNull())


def first_hit_cdf(kmins: DataFrame, grid: list[int]) -> DataFrame:
    """Share of targets first hit at or below each capacity, by arm."""
    total = kmins.groupBy("target_membership").agg(F.count("*").alias("n"))
    points = total.withColumn("capacity_k", F.explode(F.array(*[F.lit(k) for k in grid if k > 0])))
    hits = kmins.where("upper_k IS NOT NULL").groupBy("target_membership", F.col("upper_k").alias("capacity_k")).agg(F.count("*").alias("first_hits"))
    w = Window.partitionBy("target_membership").orderBy("capacity_k")
    joined = points.join(hits, ["target_membership", "capacity_k"], "left").fillna(0, ["first_hits"])
    return joined.select("target_membership", "capacity_k", "first_hits", r9(ratio(F.sum("first_hits").over(w), F.col("n"))).alias("cdf"))


def four_cells(att: DataFrame, first_field: str, second_field: str) -> DataFrame:
    """Means of two states by two arms and their contrasts, in one pass; states are two fields."""
    mean = lambda arm, f: ratio(F.sum(F.when((F.col("target_membership") == arm) & (F.col("field") == f), is_hit())), F.count_if((F.col("target_membership") == arm) & (F.col("field") == f)))
    m = att.agg(mean("trained", first_field).alias("a"), mean("control", first_field).alias("b"), mean("trained", second_field).alias("c"), mean("control", second_field).alias("d"))
    out = {"first_d": "a", "first_c": "b", "second_d": "c", "second_c": "d", "tau_first": "a - b", "tau_second": "c - d", "did": "(a - b) - (c - d)", "shift_c": "b - d"}
    return m.select(*[r9(F.expr(e)).alias(k) for k, e in out.items()])


def usable_points(points: DataFrame, tolerances: list[float]) -> DataFrame:
    """Per tolerance: capacities whose control upper bound is within it and whose tau excludes 0."""
    t = points.withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances))))
    good = (F.col("c_hi") <= F.col("tolerance")) & (F.col("tau_lo") > 0)
    return t.groupBy("tolerance").agg(F.count_if(good).alias("n_usable"), F.max(F.when(good, F.col("capacity_k"))).alias("k_star"))


#: Effective sizes of an arm for uniform Wilson intervals: its targets alone, and all repeated attempts, at an intraclass correlation of one half.
CONVENTIONS = {"targets": 100 / 3, "attempts": 300 / 7}


def wilson_sensitivity(points: DataFrame, tolerances: list[float], conventions: dict[str, float] | None = None) -> DataFrame:
    """convention, tolerance and, comma-joined, the capacities above 0 whose control upper bound is within it (floor), and of those the ones whose tau excludes 0 (any), is positive or negative; Wilson and MOVER throughout, with each convention's size."""
    sized = F.explode(F.array(*[F.struct(F.lit(k).alias("convention"), F.lit(float(v)).alias("size")) for k, v in (conventions or CONVENTIONS).items()]))
    p = points.where("capacity_k > 0").select("capacity_k", (F.col("hits_d") / F.col("n_d")).alias("d"), (F.col("hits_c") / F.col("n_c")).alias("c"), sized.alias("s")).select("capacity_k", "d", "c", "s.*")
    of_d, of_c = wilson(F.col("d"), F.col("size")), wilson(F.col("c"), F.col("size"))
    lo, hi = mover(F.col("d"), of_d, F.col("c"), of_c)
    each = p.select("convention", "capacity_k", of_c[1].alias("upper"), lo.alias("lo"), hi.alias("hi")).withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances))))
    good = F.col("upper") <= F.col("tolerance")
    named = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(good & c, F.col("capacity_k")))), ",")
    positive, negative = F.col("lo") > 0, F.col("hi") < 0
    return each.groupBy("convention", "tolerance").agg(named(F.lit(True)).alias("floor"), named(positive | negative).alias("any"), named(positive).alias("positive"), named(negative).alias("negative"))


def budget_table(att: DataFrame, *by: str, cost: str = "forward_passes", seconds: str | None = None) -> DataFrame:
    """by, rates of both arms, adj (their difference), trained persons, and the mean cost of an attempt, so that ways of searching are compared at what they spend; with ``seconds`` also its mean."""
    arm = lambda name: F.col("target_membership") == name
    rate = lambda name: ratio(F.sum(F.when(arm(name), is_hit())), F.count_if(arm(name)))
    more = [r9(F.avg(seconds)).alias("mean_seconds")] if seconds else []
    sums = att.groupBy(*by).agg(rate("trained").alias("d"), rate("control").alias("c"), F.countDistinct(F.when(arm("trained"), F.col("person_id"))).alias("persons"), r9(F.avg(F.col(cost).cast("double"))).alias(f"mean_{cost}"), *more)
    return sums.select(*by, r9(F.col("d")).alias("rate_d"), r9(F.col("c")).alias("rate_c"), r9(F.col("d") - F.col("c")).alias("adj"), "persons", f"mean_{cost}", *(["mean_seconds"] if seconds else []))


def peak_envelope(points: DataFrame, near: float = 1e-12) -> DataFrame:
    """Largest tau and the first and last capacity that reach it."""
    top = points.agg(F.max("tau").alias("top"))
    tied = points.crossJoin(F.broadcast(top)).where(F.col("tau") >= F.col("top") - near)
    return tied.groupBy("top").agg(F.min("capacity_k").alias("low_k"), F.max("capacity_k").alias("high_k")).withColumnRenamed("top", "peak_tau")


def crossing(points: DataFrame, rate: str, levels: list[float], log2: bool = True) -> DataFrame:
    """Per level: status (no_data, already_above, crosses, never) and where the curve first crosses, linear in log2 k or k."""
    x = F.log2(F.col("capacity_k").cast("double")) if log2 else F.col("capacity_k").cast("double")
    p = points.where("capacity_k > 0").select("capacity_k", x.alias("x"), F.col(rate).alias("y")).where("y IS NOT NULL")
    p = p.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    w = Window.partitionBy("level").orderBy("capacity_k")
    p = p.withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w))
    up = (F.col("y0") < F.col("level")) & (F.col("y") >= F.col("level"))
    at = F.col("x0") + (F.col("level") - F.col("y0")) / (F.col("y") - F.col("y0")) * (F.col("x") - F.col("x0"))
    done = p.groupBy("level").agg(F.min_by("y", "capacity_k").alias("start"), F.min(F.when(up, F.struct("capacity_k", at.alias("at")))).alias("c"))
    done = points.sparkSession.createDataFrame([(float(x),) for x in levels], "level double").join(done, "level", "left")
    above = F.col("start") >= F.col("level")
    found = F.pow(F.lit(2.0), F.col("c.at")) if log2 else F.col("c.at")
    return done.select("level", F.when(F.col("start").isNull(), "no_data").when(above, "already_above").when(F.col("c").isNotNull(), "crosses").otherwise("never").alias("status"), r9(F.when(~above, found)).alias("crossing_k"))


def holm(tests: DataFrame, name: str = "name", p: str = "p") -> DataFrame:
    """Step-down adjusted p values; null and NaN tests are left out."""
    some = tests.where(F.col(p).isNotNull() & ~F.isnan(p))
    w = Window.orderBy(p, name)
    m = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    stepped = some.withColumn("step", step)
    return stepped.select(name, p, r9(F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("p_holm"))
