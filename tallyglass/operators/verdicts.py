"""Further resampled intervals, trend and peak statistics per replicate, and the verdicts drawn from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.intervals import ratio
from tallyglass.operators import bounds
from tallyglass.operators import draws as draws_
from tallyglass.operators.ranks import average_rank, correlation, kept
from tallyglass.operators.rates import is_hit, r9
from tallyglass.operators.resample import drawn_rows, percentile_ci, replicates
from tallyglass.operators.shards import require_formal
from tallyglass.operators.survival import slope_interval


def mean_ci(values: DataFrame, index: str, value: str, reps: int, name: str = "mean") -> DataFrame:
    """n, mean and its percentile interval; rows are drawn."""
    means = drawn_rows(values, index, [value], reps, name).select("rep", ratio(F.col(value), F.col("n")).alias("m"))
    point = values.agg(F.count("*").alias("n"), r9(F.avg(value)).alias("mean"))
    return point.crossJoin(F.broadcast(percentile_ci(means, "m")))


def paired_ci(pairs: DataFrame, index: str, reps: int, base: str = "x", other: str = "y", name: str = "paired") -> DataFrame:
    """Rates of both sides, their difference and ratio with percentile intervals; pairs are drawn, and replicates whose base is 0 have no ratio."""
    mean = lambda c: ratio(F.col(c), F.col("n"))
    reps_ = drawn_rows(pairs, index, [base, other], reps, name).select("rep", mean(base).alias("a"), mean(other).alias("b")).withColumn("diff", F.col("b") - F.col("a")).withColumn("ratio", ratio(F.col("b"), F.col("a")))
    q = lambda c, p: r9(F.percentile(c, F.lit(p)))
    ends = reps_.agg(q("diff", 0.025).alias("diff_lo"), q("diff", 0.975).alias("diff_hi"), F.count("ratio").alias("ratios"), q("ratio", 0.025).alias("ratio_lo"), q("ratio", 0.975).alias("ratio_hi"))
    point = pairs.agg(F.count("*").alias("n"), r9(F.avg(base)).alias("base_rate"), r9(F.avg(other)).alias("other_rate"), r9(F.avg(other) - F.avg(base)).alias("diff"), r9(ratio(F.avg(other), F.avg(base))).alias("ratio"))
    return point.crossJoin(F.broadcast(ends))


def cluster_rate_ci(att: DataFrame, reps: int, *by: str, level: float = 0.95) -> DataFrame:
    return cluster_rate_of(att, replicates(att, reps, *by), *by, level=level)


def cluster_rate_of(att: DataFrame, reps: DataFrame, *by: str, level: float = 0.95) -> DataFrame:
    """arm, by, rate, lo, hi, method: the person-drawn interval of the replicates, or the exact bounds over persons where the rate is 0 or 1."""
    keys = ["target_membership", *by]
    point = att.groupBy(*keys).agg(ratio(F.sum(is_hit()), F.count("*")).alias("rate"), F.countDistinct("person_id").alias("persons"))
    ends = percentile_ci(reps, "rate", *keys).drop("reps")
    far = F.pow(F.lit((1 - level) / 2), 1 / F.col("persons"))
    zero, one = F.col("rate") == 0, F.col("rate") == 1
    lo = F.when(zero, 0.0).when(one, r9(far)).otherwise(F.col("lo"))
    hi = F.when(zero, r9(1 - far)).when(one, 1.0).otherwise(F.col("hi"))
    return point.join(ends, keys).select(*keys, r9("rate").alias("rate"), "persons", lo.alias("lo"), hi.alias("hi"), F.when(zero | one, "exact").otherwise("bootstrap").alias("method"))


def field_points(att: DataFrame, bits: Column | None = None) -> DataFrame:
    """field, capacity_k, n and rate of both arms, tau, and the recall fraction m = tau / (1 - alpha) with its standard error, over attempts; with ``bits`` also their mean over targets tried.

    m and its error are null where every control is hit.
    """
    side = lambda arm, c: F.sum(F.when(F.col("target_membership") == arm, c).otherwise(0))
    sums = att.groupBy("field", "capacity_k").agg(side("trained", F.lit(1)).alias("n_d"), side("control", F.lit(1)).alias("n_c"), side("trained", is_hit()).alias("h_d"), side("control", is_hit()).alias("h_c"), *([r9(F.avg(bits)).alias("bits")] if bits is not None else []))
    pi, alpha = ratio(F.col("h_d"), F.col("n_d")), ratio(F.col("h_c"), F.col("n_c"))
    m, se = bounds.recall_fraction(pi, alpha), bounds.recall_fraction_se(pi, alpha, F.col("n_d"), F.col("n_c"))
    return sums.select("field", "capacity_k", "n_d", "n_c", r9(pi).alias("pi"), r9(alpha).alias("alpha"), r9(pi - alpha).alias("tau"), r9(m).alias("m"), r9(se).alias("m_se"), *(["bits"] if bits is not None else []))


def paired_cells_ci(att: DataFrame, reps: int, first_field: str, second_field: str, pair: Column) -> DataFrame:
    """name, point, lo, hi of the contrasts of two states (two fields) by two arms; frozen pairs of persons are drawn."""
    cell = lambda arm, f, c: F.sum(F.when((F.col("target_membership") == arm) & (F.col("field") == f), c).otherwise(0))
    each = {n: (arm, f) for n, arm, f in (("a", "trained", first_field), ("b", "control", first_field), ("c", "trained", second_field), ("d", "control", second_field))}
    sums = att.withColumn("pair", pair).groupBy("pair").agg(*[cell(*v, is_hit()).alias(f"h{k}") for k, v in each.items()], *[cell(*v, F.lit(1)).alias(f"n{k}") for k, v in each.items()])
    contrasts = {"tau_first": "a - b", "tau_second": "c - d", "did": "(a - b) - (c - d)", "shift_c": "b - d"}

    def table(rows: DataFrame, *keys: str) -> DataFrame:
        means = rows.groupBy(*keys).agg(*[ratio(F.sum(f"h{k}"), F.sum(f"n{k}")).alias(k) for k in each])
        long = F.array(*[F.struct(F.lit(k).alias("name"), F.expr(e).alias("value")) for k, e in contrasts.items()])
        return means.select(*keys, F.explode(long).alias("s")).select(*keys, "s.*")

    drawn = drawn_rows(sums, "pair", [f"{c}{k}" for k in each for c in "hn"], reps, "cube")
    ends = percentile_ci(table(drawn, "rep"), "value", "name").drop("reps")
    return table(sums).select("name", r9("value").alias("point")).join(ends, "name")


def binomial_replicates(points: DataFrame, reps: int, name: str, hits: str = "hits_c", n: str = "n_c") -> DataFrame:
    """rep, capacity_k, rate: each point's count drawn anew from the binomial distribution of its rate, where there are no persons to draw.

    A draw is the least count whose distribution reaches a number in (0, 1) from md5, so another engine repeats it. Of the distribution only the counts within nine
    standard deviations are laid out, each from its neighbour's ratio; so a point of n attempts costs about 18 sqrt(n) numbers, not n.
    """
    p = F.col("h") / F.col("m")
    spread = 9 * F.sqrt(F.col("m") * p * (1 - p))
    sure = (F.col("h") == 0) | (F.col("h") == F.col("m"))
    low = F.when(sure, F.col("h")).otherwise(F.greatest(F.lit(0.0), F.floor(F.col("h") - spread - 1)))
    high = F.when(sure, F.col("h")).otherwise(F.least(F.col("m"), F.ceil(F.col("h") + spread + 1)))
    cells = points.where(F.col(n) > 0).select("capacity_k", F.col(hits).cast("double").alias("h"), F.col(n).cast("double").alias("m")).select("*", low.cast("long").alias("low"), high.cast("long").alias("high"))
    each = cells.select("capacity_k", "h", "m", "low", F.explode(F.sequence("low", "high")).alias("x"))
    ratio_ = F.when(F.col("x") == F.col("low"), 0.0).otherwise(F.log((F.col("m") - F.col("x") + 1) / F.col("x")) + F.log(F.col("h") / (F.col("m") - F.col("h"))))
    upto = Window.partitionBy("capacity_k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("capacity_k")
    logs = each.withColumn("log", F.sum(ratio_).over(upto))
    mass = logs.withColumn("mass", F.exp(F.col("log") - F.max("log").over(all_)))
    cdf = mass.withColumn("cdf", F.sum("mass").over(upto) / F.sum("mass").over(all_))
    listed = cdf.groupBy("capacity_k", "m", "low").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "cdf"))), lambda s: s.cdf).alias("cdf"))
    drawn = listed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    key = F.concat_ws("|", F.lit(name), F.col("rep").cast("string"), F.col("capacity_k").cast("string"))
    u = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    below = F.size(F.filter("cdf", lambda c: c < u))
    return drawn.select("rep", "capacity_k", (F.col("low") + F.least(below, F.size("cdf") - 1)).alias("x"), "m").select("rep", "capacity_k", (F.col("x") / F.col("m")).alias("rate"))


def crossing_replicates(reps: DataFrame, levels: list[float], value: str = "rate") -> DataFrame:
    """rep, level, k: where each replicate's curve first crosses each level, linear in log2 k; null where it doesn't."""
    p = reps.where("capacity_k > 0").withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("x", F.log2(F.col("capacity_k").cast("double")))
    w = Window.partitionBy("rep", "level").orderBy("capacity_k")
    p = p.withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag(value).over(w))
    up = (F.col("y0") < F.col("level")) & (F.col(value) >= F.col("level"))
    at = F.col("x0") + (F.col("level") - F.col("y0")) / (F.col(value) - F.col("y0")) * (F.col("x") - F.col("x0"))
    first = F.min(F.when(up, F.struct("capacity_k", at.alias("at"))))["at"]
    return p.groupBy("rep", "level").agg(F.pow(F.lit(2.0), first).alias("k"))


def rank_trend(reps: DataFrame, value: str = "rate") -> DataFrame:
    """rep, rho: Spearman's correlation of capacity and value within each replicate; null where either is constant."""
    p = reps.where("capacity_k > 0")
    ranked = average_rank(average_rank(p, "capacity_k", "rep", name="rx"), value, "rep", name="ry")
    return ranked.groupBy("rep").agg(correlation("rx", "ry").alias("rho"))


def quadratic_weights(grid: list[int]) -> dict[int, float]:
    """For each capacity its weight in the least-squares coefficient of (log k)^2, so that a curve's coefficient is a weighted sum."""
    x = np.log([k for k in grid if k > 0])
    solve = np.linalg.pinv(np.stack([np.ones(len(x)), x, x * x], axis=1))
    return dict(zip([k for k in grid if k > 0], solve[2].tolist(), strict=True))


def peaks(reps: DataFrame, grid: list[int], value: str = "tau", near: float = 1e-12) -> DataFrame:
    """rep, earliest, latest, ties, quadratic: first and last capacity at the largest value, how many reach it, and the curve's log-quadratic coefficient."""
    weight = F.create_map(*[F.lit(x) for pair in quadratic_weights(grid).items() for x in pair])
    p = reps.where("capacity_k > 0").withColumn("top", F.max(value).over(Window.partitionBy("rep")))
    tied = F.col(value) >= F.col("top") - near
    k = F.when(tied, F.col("capacity_k"))
    return p.groupBy("rep").agg(F.min(k).alias("earliest"), F.max(k).alias("latest"), F.count_if(tied).alias("ties"), F.sum(weight[F.col("capacity_k")] * F.col(value)).alias("quadratic"))


def centred_p(reps: DataFrame, value: str, point: float, null: float = 0.0, two_sided: bool = True) -> Column:
    """The bootstrap p of ``point`` against ``null`` from replicates centred on it; left tail if not two-sided."""
    moved = F.col(value) - point
    far = F.abs(moved) >= abs(point - null) - 1e-12 if two_sided else moved + null <= point + 1e-12
    return (F.count_if(far) + 1) / (F.count(value) + 1)


def curve_verdicts(att: DataFrame, reps: int, grid: list[int], k: int, more: dict[str, float] | None = None, level: float = 0.05, least_valid: float = 0.95, targets: DataFrame | None = None, seed: int = draws_.SEED, formal: bool = False) -> DataFrame:
    """name, point, lo, hi, p, p_holm, verdict of the trend of the control floor (H1), the signal at capacity k (H3), the thresholds' slope (H4) and the peak (H5).

    All of them share the same draws of persons. ``targets``: thresholds (target_membership, person_id, h, low, high) of the arm that H4 is about; without them there
    is no H4. ``more``: p values of other hypotheses of the family; H2 has no test of its own and keeps a place at p = 1. H5 is
    exploratory and outside the family. Raises where fewer than ``least_valid`` of the replicates have a trend, where a refit of H4 fails, and, if
    ``formal``, unless replicates and seed are the registered ones.
    """
    if formal:
        require_formal(reps, seed)
    at = kept(draws_.places(att))
    r = kept(draws_.rate_replicates(att, reps, "capacity_k", at=at, seed=seed))
    one = lambda arm, name: r.where(F.col("target_membership") == arm).select("rep", "capacity_k", F.col("rate").alias(name))
    tau = one("trained", "d").join(one("control", "c"), ["rep", "capacity_k"]).withColumn("tau", F.col("d") - F.col("c"))
    rows = att.groupBy("capacity_k").agg(*[ratio(F.sum(F.when(F.col("target_membership") == arm, is_hit())), F.count_if(F.col("target_membership") == arm)).alias(n) for arm, n in (("trained", "d"), ("control", "c"))])
    points = rows.select(F.lit(0).alias("rep"), "capacity_k", "c", (F.col("d") - F.col("c")).alias("tau"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    rho = rank_trend(points, "c").first()["rho"]
    h1 = rank_trend(one("control", "c"), "c").agg(F.count("rho").alias("n"), q("rho", 0.025).alias("lo"), q("rho", 0.975).alias("hi"), ((F.count_if(F.col("rho") <= 0) + 1) / (F.count("rho") + 1)).alias("p")).first()
    if h1["n"] < least_valid * reps:
        raise ValueError(f"only {h1['n']} of {reps} replicates have a trend")
    here = points.where(F.col("capacity_k") == k).first()["tau"]
    mine = tau.where(F.col("capacity_k") == k)
    h3 = mine.agg(q("tau", 0.025).alias("lo"), q("tau", 0.975).alias("hi"), centred_p(mine, "tau", here).alias("p")).first()
    curved = peaks(points, grid).first()["quadratic"]
    each = peaks(tau, grid)
    h5 = each.agg(q("earliest", 0.025).alias("lo"), q("latest", 0.975).alias("hi"), centred_p(each, "quadratic", curved, two_sided=False).alias("p")).first()
    h4 = None if targets is None else slope_interval(targets, reps, seed=seed, at=at).first()
    family = {"H1": h1["p"], "H2": 1.0, "H3": h3["p"]} | ({"H4": h4["p"]} if h4 else {}) | (more or {})
    adjusted, running = {}, 0.0
    for i, name in enumerate(sorted(family, key=family.get)):
        adjusted[name] = running = max(running, min(1.0, (len(family) - i) * family[name]))
    signal = "positive" if h3["lo"] > 0 else "negative" if h3["hi"] < 0 else None
    inside = h5["lo"] > min(x for x in grid if x > 0) and h5["hi"] < max(grid)
    said = {
        "H1": "supported" if h1["lo"] > 0 and adjusted["H1"] <= level else "not supported",
        "H2": "unresolved: no global test",
        "H3": f"measurable {signal} signal" if signal and adjusted["H3"] <= level else "zero is not rejected",
        "H5": "interior peak (exploratory)" if inside else "peak is not localised (exploratory)",
    } | {name: "rejected" if adjusted[name] <= level else "not rejected" for name in more or {}}
    ends = {"H1": (rho, h1), "H3": (here, h3), "H5": (curved, h5)}
    if h4:
        said["H4"] = "proportionality is not rejected" if h4["lo"] <= 1 <= h4["hi"] or adjusted["H4"] > level else "proportionality is refuted"
        ends["H4"] = (h4["slope"], h4)
    made = [(n, *(float(x) if x is not None else None for x in ((ends[n][0], ends[n][1]["lo"], ends[n][1]["hi"], ends[n][1]["p"]) if n in ends else (None, None, None, family[n]))), adjusted.get(n), said[n]) for n in sorted(said)]
    return att.sparkSession.createDataFrame(made, "name string, point double, lo double, hi double, p double, p_holm double, verdict string")
