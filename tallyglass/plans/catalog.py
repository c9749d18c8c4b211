"""All queries of the audit engine and, where SQL can express them, their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.functions import text as X
from tallyglass.functions.intervals import Z95, ratio
from tallyglass.operators import bounds, corpus, draws, exposure, gates, matching, models, ranked, ranks, rates, resample, shards, survival
from tallyglass.operators.rates import is_hit, r9
from tallyglass.sources.attempts import GRID, event_attempts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REPS = 200
FORMAL_REPS = 10_000  # what an interval that decides needs
AUC_REPS = 2_000
TOLERANCES = [0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
PAST = ", ".join(f"({k})" for k in GRID)

#: The attempts of ``event_attempts`` and its curve, for the other engine.
ATT = f"""grid AS (SELECT row_number() OVER () - 1 AS i, k FROM (VALUES {PAST}) g(k)),
raw AS (SELECT *, CAST(props->>'k' AS INT) % 14 AS i FROM events),
att AS (SELECT event_id, event_id % 3 AS seed, user_id AS person_id, event_type AS field,
  CASE WHEN user_id % 2 = 0 THEN 'trained' ELSE 'control' END AS target_membership, grid.k AS capacity_k, value AS final_target_nll,
  CASE WHEN value <= grid.k * (CASE WHEN user_id % 2 = 0 THEN 5.0 ELSE 4.0 END) THEN 1 ELSE 0 END AS hit
  FROM raw LEFT JOIN grid USING (i))"""
CURVE = f"""cells AS (SELECT capacity_k, sum(hit) FILTER (target_membership = 'trained') AS hits_d, count(*) FILTER (target_membership = 'trained') AS n_d,
  sum(hit) FILTER (target_membership = 'control') AS hits_c, count(*) FILTER (target_membership = 'control') AS n_c FROM att GROUP BY 1),
p AS (SELECT *, hits_d / n_d::DOUBLE AS d, hits_c / n_c::DOUBLE AS c, {Z95!r}::DOUBLE AS z FROM cells),
b AS (SELECT *, z / (1 + z * z / n_d) * sqrt(d * (1 - d) / n_d + z * z / (4.0::DOUBLE * n_d * n_d)) AS hd, (d + z * z / (2 * n_d)) / (1 + z * z / n_d) AS md,
  z / (1 + z * z / n_c) * sqrt(c * (1 - c) / n_c + z * z / (4.0::DOUBLE * n_c * n_c)) AS hc, (c + z * z / (2 * n_c)) / (1 + z * z / n_c) AS mc FROM p),
w AS (SELECT *, greatest(0, md - hd) AS dl, least(1, md + hd) AS dh, greatest(0, mc - hc) AS cl, least(1, mc + hc) AS ch FROM b),
curve AS (SELECT capacity_k, CAST(hits_d AS BIGINT) AS hits_d, n_d, CAST(hits_c AS BIGINT) AS hits_c, n_c, round(d, 9) AS rate_d, round(c, 9) AS rate_c, round(dl, 9) AS d_lo, round(dh, 9) AS d_hi,
  round(cl, 9) AS c_lo, round(ch, 9) AS c_hi, round(d - c, 9) AS tau, round(d - c - sqrt((d - dl) ** 2 + (ch - c) ** 2), 9) AS tau_lo, round(d - c + sqrt((dh - d) ** 2 + (c - cl) ** 2), 9) AS tau_hi FROM w)"""
KMIN = f"""cell AS (SELECT target_membership, person_id, field, capacity_k, max(hit) AS hit FROM att WHERE capacity_k > 0 GROUP BY ALL),
top AS (SELECT *, min(CASE WHEN hit = 1 THEN capacity_k END) OVER (PARTITION BY target_membership, person_id, field) AS upper_k FROM cell),
km AS (SELECT target_membership, person_id, field, upper_k, coalesce(bool_or(capacity_k > upper_k AND hit = 0), false) AS nonmonotone FROM top GROUP BY ALL),
kmin AS (SELECT km.*, CASE WHEN upper_k IS NULL THEN {GRID[-1]} ELSE (SELECT coalesce(max(k), 0) FROM grid WHERE k < upper_k) END AS lower_k, upper_k IS NULL AS right_censored FROM km)"""


def query(sql: str | None = None, uses: tuple[str, ...] = (ATT,)):
    """Registers a query under its name, with SQL over the common tables ``uses``."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH {', '.join(uses)} " if uses else "") + sql
        return f

    return keep


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- rates ---------------------------------------------------------------------


@query("SELECT target_membership, capacity_k, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n, round(sum(hit) / count(*)::DOUBLE, 9) AS rate FROM att WHERE capacity_k IS NOT NULL GROUP BY 1, 2")
def arm_capacity_curve(spark, d):
    return rates.rates(event_attempts(spark, d), "target_membership", "capacity_k")


@query("SELECT * FROM curve", (ATT, CURVE))
def curve_wilson_tau(spark, d):
    return rates.curve(event_attempts(spark, d))


@query("SELECT target_membership, field, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n, CAST(grouping_id(target_membership, field) AS BIGINT) AS level, round(sum(hit) / count(*)::DOUBLE, 9) AS rate FROM att GROUP BY GROUPING SETS ((target_membership, field), (field), ())")
def breakdown_grouping_sets(spark, d):
    return rates.grouping_sets(event_attempts(spark, d))


@query("SELECT coalesce(target_membership, 'Overall') AS arm, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n, round(sum(hit) / count(*)::DOUBLE, 9) AS rate FROM att GROUP BY ROLLUP (target_membership)")
def overall_rollup(spark, d):
    return rates.rollup(event_attempts(spark, d))


@query("SELECT target_membership, person_id, count(*) AS n_fields, CAST(sum(h) AS BIGINT) AS n_hit, min(h) = 1 AS all_hit, max(h) = 1 AS any_hit FROM (SELECT target_membership, person_id, field, max(hit) AS h FROM att GROUP BY ALL) GROUP BY ALL")
def record_level(spark, d):
    return rates.records(event_attempts(spark, d))


@query(f"SELECT target_membership, field, {', '.join(f'CAST(sum(CASE WHEN capacity_k = {k} THEN hit ELSE 0 END) AS BIGINT) AS k{k}' for k in GRID)} FROM att GROUP BY ALL")
def hit_matrix_pivot(spark, d):
    return rates.hit_matrix(event_attempts(spark, d), GRID)


@query("SELECT target_membership, count(*) AS n_seeds, round(avg(r), 9) AS mean, round(coalesce(stddev_samp(r), 0), 9) AS sd FROM (SELECT target_membership, seed, sum(hit) / count(*)::DOUBLE AS r FROM att GROUP BY ALL) GROUP BY ALL")
def across_seeds(spark, d):
    return rates.across_seeds(event_attempts(spark, d))


@query("SELECT target_membership, attempts, r, count(*) AS cells FROM (SELECT target_membership, person_id, field, capacity_k, CAST(sum(hit) AS BIGINT) AS r, count(*) AS attempts FROM att GROUP BY ALL) GROUP BY ALL")
def seed_variance(spark, d):
    return rates.seed_spread(event_attempts(spark, d))


@query("SELECT target_membership, person_id, field, upper_k, nonmonotone, lower_k, right_censored FROM kmin", (ATT, KMIN))
def kmin_intervals(spark, d):
    return rates.kmin(event_attempts(spark, d), GRID)


@query("SELECT target_membership, count(*) AS n, count(*) FILTER (right_censored) AS n_censored, count(*) FILTER (nonmonotone) AS n_nonmonotone, quantile_cont(upper_k, 0.5) AS median_k FROM kmin GROUP BY ALL", (ATT, KMIN))
def censor_summary(spark, d):
    return survival.censor_summary(rates.kmin(event_attempts(spark, d), GRID))


@query("SELECT t.target_membership, g.k AS capacity_k, count(*) FILTER (upper_k = g.k) AS first_hits, round(count(*) FILTER (upper_k <= g.k) / count(*)::DOUBLE, 9) AS cdf FROM kmin t CROSS JOIN (SELECT k FROM grid WHERE k > 0) g GROUP BY ALL", (ATT, KMIN))
def first_hit_cdf(spark, d):
    return rates.first_hit_cdf(rates.kmin(event_attempts(spark, d), GRID), GRID)


@query("SELECT field, count(*) AS n, round(regr_slope(upper_k, h), 9) AS slope, round(corr(upper_k, h), 9) AS r, round(stddev_pop(upper_k), 9) AS spread FROM (SELECT field, upper_k::DOUBLE AS upper_k, (28 + 1.5 * (person_id % 50))::DOUBLE AS h FROM kmin WHERE upper_k IS NOT NULL) GROUP BY ALL", (ATT, KMIN))
def kmin_regression(spark, d):
    k = rates.kmin(event_attempts(spark, d), GRID).where("upper_k IS NOT NULL").select("field", F.col("upper_k").cast("double").alias("y"), (28 + F.lit(1.5) * (F.col("person_id") % 50)).cast("double").alias("h"))
    return k.groupBy("field").agg(F.count("*").alias("n"), r9(F.regr_slope("y", "h")).alias("slope"), r9(F.corr("y", "h")).alias("r"), r9(F.stddev_pop("y")).alias("spread"))


@query("SELECT target_membership, count(*) AS n, round(count(*) FILTER (upper_k < 10 + person_id % 9) / count(*)::DOUBLE, 9) AS share FROM kmin GROUP BY ALL", (ATT, KMIN))
def shorter_than_target(spark, d):
    short = F.coalesce(F.col("upper_k") < 10 + F.col("person_id") % 9, F.lit(False))
    return rates.kmin(event_attempts(spark, d), GRID).groupBy("target_membership").agg(F.count("*").alias("n"), r9(ratio(F.count_if(short), F.count("*"))).alias("share"))


@query("SELECT round(a, 9) AS first_d, round(b, 9) AS first_c, round(c, 9) AS second_d, round(d, 9) AS second_c, round(a - b, 9) AS tau_first, round(c - d, 9) AS tau_second, round((a - b) - (c - d), 9) AS did, round(b - d, 9) AS shift_c FROM (SELECT " + ", ".join(f"sum(hit) FILTER (target_membership = '{arm}' AND field = '{f}') / (count(*) FILTER (target_membership = '{arm}' AND field = '{f}'))::DOUBLE AS {n}" for n, arm, f in (("a", "trained", "click"), ("b", "control", "click"), ("c", "trained", "view"), ("d", "control", "view"))) + " FROM att)")
def four_cell_contrasts(spark, d):
    return rates.four_cells(event_attempts(spark, d), "click", "view")


@query(f"SELECT tolerance, count(*) FILTER (c_hi <= tolerance AND tau_lo > 0) AS n_usable, max(capacity_k) FILTER (c_hi <= tolerance AND tau_lo > 0) AS k_star FROM curve CROSS JOIN (SELECT unnest({TOLERANCES})::DOUBLE AS tolerance) GROUP BY ALL", (ATT, CURVE))
def usable_points(spark, d):
    return rates.usable_points(rates.curve(event_attempts(spark, d)).where("capacity_k IS NOT NULL"), TOLERANCES)


@query("SELECT m AS peak_tau, min(capacity_k) AS low_k, max(capacity_k) AS high_k FROM curve, (SELECT max(tau) AS m FROM curve) WHERE tau >= m - 1e-12 GROUP BY m", (ATT, CURVE))
def peak_envelope(spark, d):
    return rates.peak_envelope(rates.curve(event_attempts(spark, d)))


@query("""SELECT level, CASE WHEN start >= level THEN 'already_above' WHEN k IS NOT NULL THEN 'crosses' ELSE 'never' END AS status, CASE WHEN start < level THEN round(2 ** place, 9) END AS crossing_k FROM (
  SELECT level, arg_min(y, capacity_k) AS start, min(capacity_k) FILTER (y0 < level AND y >= level) AS k, arg_min(x0 + (level - y0) / (y - y0) * (x - x0), capacity_k) FILTER (y0 < level AND y >= level) AS place FROM (
    SELECT *, lag(x) OVER o AS x0, lag(y) OVER o AS y0 FROM (SELECT capacity_k, log2(capacity_k) AS x, rate_c AS y, level FROM curve CROSS JOIN (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS level) WHERE capacity_k > 0) WINDOW o AS (PARTITION BY level ORDER BY capacity_k)) GROUP BY level)""", (ATT, CURVE))  # fmt: skip
def crossing_log2k(spark, d):
    return rates.crossing(rates.curve(event_attempts(spark, d)), "rate_c", [0.05, 0.25, 0.5, 0.75, 0.99])


@query("SELECT name, p, round(max(step) OVER (ORDER BY p, name), 9) AS p_holm FROM (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS step FROM (SELECT field AS name, round(sum(hit) / count(*)::DOUBLE / 50, 9) AS p FROM att GROUP BY ALL))")
def holm_adjust(spark, d):
    tests = event_attempts(spark, d).groupBy(F.col("field").alias("name")).agg(r9(ratio(F.sum(is_hit()), F.count("*")) / 50).alias("p"))
    return rates.holm(tests)


@query("SELECT target_membership, count(*) AS attempts, count(DISTINCT person_id) AS persons, count(DISTINCT (person_id, field)) AS targets, round(avg(final_target_nll), 9) AS mean_nll, round(median(final_target_nll), 9) AS median_nll, round(quantile_cont(final_target_nll, 0.75) - quantile_cont(final_target_nll, 0.25), 9) AS iqr FROM att GROUP BY ALL")
def compute_profile(spark, d):
    att = event_attempts(spark, d)
    spread = ranks.quantiles(att, "target_membership", "final_target_nll", {"q1": 0.25, "median": 0.5, "q3": 0.75}).select("target_membership", r9(F.col("median")).alias("median_nll"), r9(F.col("q3") - F.col("q1")).alias("iqr"))
    sums = att.groupBy("target_membership").agg(F.count("*").alias("attempts"), F.countDistinct("person_id").alias("persons"), F.countDistinct("person_id", "field").alias("targets"), r9(F.avg("final_target_nll")).alias("mean_nll"))
    return sums.join(spread, "target_membership")


@query("SELECT field, round((sum(hit) FILTER (seed = 1) / (count(*) FILTER (seed = 1))::DOUBLE) / nullif(sum(hit) FILTER (seed = 0) / (count(*) FILTER (seed = 0))::DOUBLE, 0), 9) AS retention FROM att GROUP BY ALL")
def transfer_retention(spark, d):
    rate = lambda s: ratio(F.sum(F.when(F.col("seed") == s, is_hit())), F.count_if(F.col("seed") == s))
    return event_attempts(spark, d).groupBy("field").agg(r9(F.try_divide(rate(1), rate(0))).alias("retention"))


# ---- ranks and pairs -------------------------------------------------------------


@query("""SELECT field, n_d, n_c, round((r - n_d * (n_d + 1) / 2.0::DOUBLE) / (n_d * n_c::DOUBLE), 9) AS auc FROM (SELECT field, count(*) FILTER (target_membership = 'trained') AS n_d, count(*) FILTER (target_membership = 'control') AS n_c, sum(rk) FILTER (target_membership = 'trained') AS r FROM (
  SELECT *, rank() OVER (PARTITION BY field ORDER BY -final_target_nll) + (count(*) OVER (PARTITION BY field, final_target_nll) - 1) / 2.0::DOUBLE AS rk FROM att) GROUP BY field)""")
def auc_by_field(spark, d):
    return ranks.auc(event_attempts(spark, d))


@query("""SELECT a.field, round(any_value(cut), 9) AS cut, round(count(*) FILTER (-final_target_nll >= cut AND target_membership = 'trained') / (count(*) FILTER (target_membership = 'trained'))::DOUBLE, 9) AS tpr, round(count(*) FILTER (-final_target_nll >= cut AND target_membership = 'control') / (count(*) FILTER (target_membership = 'control'))::DOUBLE, 9) AS fpr
  FROM att a JOIN (SELECT field, s AS cut FROM (SELECT field, -final_target_nll AS s, row_number() OVER (PARTITION BY field ORDER BY -final_target_nll) AS rn, count(*) OVER (PARTITION BY field) AS n FROM att WHERE target_membership = 'control') WHERE rn = ceil((n - 1) * 0.9::DOUBLE) + 1) q ON a.field = q.field GROUP BY a.field""")
def tpr_at_fpr(spark, d):
    return ranks.tpr_at_fpr(event_attempts(spark, d), 0.1)


@query("""SELECT field, CAST(sum(under) AS BIGINT) AS inverted, count(*) FILTER (under > 0) AS beaten, count(*) AS n_d, any_value(n_c) AS n_c, round(sum(under) / (count(*) * any_value(n_c))::DOUBLE, 9) AS share FROM (
  SELECT t.event_id, t.field, count(c.event_id) AS under, any_value(n.n) AS n_c FROM att t JOIN (SELECT field, count(*) AS n FROM att WHERE target_membership = 'control' GROUP BY 1) n ON n.field = t.field
  LEFT JOIN att c ON c.target_membership = 'control' AND c.field = t.field AND c.final_target_nll < t.final_target_nll WHERE t.target_membership = 'trained' GROUP BY ALL) GROUP BY field""")
def rank_inversion(spark, d):
    return ranks.inversions(event_attempts(spark, d))


@query("SELECT count(*) AS n, round(corr(rx, ry), 9) AS rho FROM (SELECT rank() OVER (ORDER BY capacity_k) + (count(*) OVER (PARTITION BY capacity_k) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY rate_c) + (count(*) OVER (PARTITION BY rate_c) - 1) / 2.0::DOUBLE AS ry FROM curve)", (ATT, CURVE))
def spearman_rate_k(spark, d):
    return ranks.spearman(rates.curve(event_attempts(spark, d)), "capacity_k", "rate_c")


PAIRED = "last AS (SELECT person_id, field, seed, capacity_k, arg_max(hit, event_id) AS hit FROM att WHERE target_membership = 'trained' AND capacity_k IN (8, 16) GROUP BY ALL), pairs AS (SELECT a.person_id, a.field, a.seed, a.hit::BIGINT AS x, b.hit::BIGINT AS y FROM last a JOIN last b USING (person_id, field, seed) WHERE a.capacity_k = 8 AND b.capacity_k = 16)"


@query("SELECT * FROM pairs", (ATT, PAIRED))
def paired_join(spark, d):
    return ranks.paired(event_attempts(spark, d), 8, 16)


@query("SELECT count(*) AS n, count(*) FILTER (x = 1 AND y = 0) AS b, count(*) FILTER (x = 0 AND y = 1) AS c, count(*) FILTER (x = 1 AND y = 1) AS both, count(*) FILTER (x = 0 AND y = 0) AS neither FROM pairs".replace("AS both", 'AS "both"'), (ATT, PAIRED))
def mcnemar_counts(spark, d):
    return ranks.discordant(ranks.paired(event_attempts(spark, d), 8, 16))


@query("""SELECT a.rn AS pair, a.person_id AS trained, b.person_id AS control FROM (SELECT person_id, row_number() OVER (ORDER BY person_id) AS rn FROM (SELECT DISTINCT person_id FROM att WHERE target_membership = 'trained')) a
  JOIN (SELECT person_id, row_number() OVER (ORDER BY person_id) AS rn FROM (SELECT DISTINCT person_id FROM att WHERE target_membership = 'control')) b USING (rn)""")
def positional_pairs(spark, d):
    att = event_attempts(spark, d)
    side = lambda arm: ranks.numbered(att.where(F.col("target_membership") == arm).select(F.col("person_id").alias(arm)).distinct(), arm, "place")
    return side("trained").join(side("control"), "place").select((F.col("place") + 1).alias("pair"), "trained", "control")


# ---- resampling --------------------------------------------------------------------

DRAWS = f"""persons AS (SELECT target_membership, person_id, row_number() OVER (PARTITION BY target_membership ORDER BY person_id) - 1 AS i, count(*) OVER (PARTITION BY target_membership) AS size FROM (SELECT DISTINCT target_membership, person_id FROM att)),
drawn AS (SELECT rep, target_membership, ('0x' || substr(md5(target_membership || '|' || rep || '|' || i), 1, 8))::BIGINT % size AS i FROM persons, range({REPS}) r(rep)),
w AS (SELECT rep, p.target_membership, p.person_id, count(*) AS w FROM drawn JOIN persons p ON p.target_membership = drawn.target_membership AND p.i = drawn.i GROUP BY ALL)"""
BY_REP = "sums AS (SELECT target_membership, person_id{k}, sum(hit) AS h, count(*) AS n FROM att GROUP BY ALL), reps AS (SELECT rep, target_membership{k}, sum(w * h)::DOUBLE / sum(w * n) AS rate FROM w JOIN sums USING (target_membership, person_id) GROUP BY ALL)"


@query("SELECT target_membership, count(*) AS reps, round(quantile_cont(rate, 0.025), 9) AS lo, round(quantile_cont(rate, 0.975), 9) AS hi FROM reps GROUP BY ALL", (ATT, DRAWS, BY_REP.format(k="")))
def bootstrap_rate_ci_hash(spark, d):
    return resample.percentile_ci(resample.replicates(event_attempts(spark, d), REPS), "rate", "target_membership")


@query("SELECT capacity_k, count(tau) AS reps, round(quantile_cont(tau, 0.025), 9) AS lo, round(quantile_cont(tau, 0.975), 9) AS hi, round(least(1.0::DOUBLE, 2 * (least(count(*) FILTER (tau <= 0), count(*) FILTER (tau >= 0)) + 1) / (count(*) + 1)::DOUBLE), 9) AS p FROM (SELECT a.capacity_k, a.rate - b.rate AS tau FROM reps a JOIN reps b ON a.rep = b.rep AND a.capacity_k = b.capacity_k WHERE a.target_membership = 'trained' AND b.target_membership = 'control') GROUP BY ALL", (ATT, DRAWS, BY_REP.format(k=", capacity_k")))
def bootstrap_curve_ci_hash(spark, d):
    return resample.difference_ci(event_attempts(spark, d), REPS, "capacity_k")


# ---- subsets, sets and gates --------------------------------------------------------


@query("SELECT person_id FROM (SELECT person_id, row_number() OVER (ORDER BY person_id) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT person_id FROM att)) WHERE rn IN (SELECT round_even(i * ((SELECT count(DISTINCT person_id) FROM att) - 1) / 19.0::DOUBLE, 0)::BIGINT FROM range(20) t(i))")
def even_subset(spark, d):
    p = event_attempts(spark, d).select("person_id").distinct()
    ranked = ranks.numbered(p, "person_id", "rn")
    size = p.agg(F.count("*").alias("size"))
    places = spark.range(20).crossJoin(F.broadcast(size)).select(F.bround(F.col("id") * (F.col("size") - 1) / F.lit(19.0)).cast("int").alias("rn")).distinct()
    return ranked.join(F.broadcast(places), "rn", "left_semi").select("person_id")


@query("SELECT field, person_id FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, person_id) AS rn FROM (SELECT field, person_id, count(*) AS n FROM att GROUP BY ALL)) ORDER BY rn, field LIMIT 25")
def round_robin_topn(spark, d):
    n = event_attempts(spark, d).groupBy("field", "person_id").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "person_id"))
    return n.withColumn("rn", rn).where("rn <= 25").orderBy("rn", "field").limit(25).select("field", "person_id")


@query("SELECT person_id, min(event_id) AS event_id, arg_min(field, event_id) AS field FROM att GROUP BY ALL")
def first_per_person(spark, d):
    return event_attempts(spark, d).groupBy("person_id").agg(F.min("event_id").alias("event_id"), F.min_by("field", "event_id").alias("field"))


@query("SELECT event_id, person_id, seed FROM att WHERE target_membership = 'control' AND person_id IN (SELECT person_id FROM att WHERE hit = 1 AND capacity_k <= 8)")
def matched_semi(spark, d):
    att = event_attempts(spark, d)
    hit = att.where("exact_match AND capacity_k <= 8").select("person_id").distinct()
    return att.where("target_membership = 'control'").join(hit, "person_id", "left_semi").select("event_id", "person_id", "seed")


@query("SELECT DISTINCT person_id, field, capacity_k FROM att WHERE seed = 0 AND capacity_k IS NOT NULL EXCEPT SELECT person_id, field, capacity_k FROM att WHERE seed = 1")
def resume_anti(spark, d):
    att, key = event_attempts(spark, d), ["person_id", "field", "capacity_k"]
    return att.where("seed = 0").select(*key).distinct().join(att.where("seed = 1").select(*key), key, "left_anti").dropna()


@query("SELECT person_id, k AS capacity_k, 'missing' AS side FROM (SELECT DISTINCT person_id FROM att) CROSS JOIN grid EXCEPT SELECT person_id, capacity_k, 'missing' FROM att")
def coord_missing(spark, d):
    att = event_attempts(spark, d)
    expected = att.select("person_id").distinct().withColumn("capacity_k", F.explode(F.array(*map(F.lit, GRID))))
    return gates.coverage(att.where("capacity_k IS NOT NULL"), expected, "person_id", "capacity_k")


@query("SELECT 'nll is a number from 0' AS rule, count(*) FILTER (NOT coalesce(final_target_nll >= 0, false)) AS violations FROM att UNION ALL SELECT 'k is on the grid', count(*) FILTER (capacity_k IS NULL) FROM att UNION ALL SELECT 'no hit at 0', count(*) FILTER (capacity_k = 0 AND hit = 1) FROM att UNION ALL SELECT 'nll below 500', count(*) FILTER (NOT coalesce(final_target_nll < 500, false)) FROM att")
def gate_violations(spark, d):
    nll, k = F.col("final_target_nll"), F.col("capacity_k")
    return gates.violations(event_attempts(spark, d), {"nll is a number from 0": nll >= 0, "k is on the grid": k.isNotNull(), "no hit at 0": (k != 0) | (is_hit() == 0), "nll below 500": nll < 500})


@query("SELECT person_id, field, capacity_k, seed, count(*) AS n FROM att GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return gates.duplicates(event_attempts(spark, d), "person_id", "field", "capacity_k", "seed")


# ---- matching -------------------------------------------------------------------------

FEATURES = ["n_chars", "n_words", "n_lines"]
DOCS = r"""f AS (SELECT doc_id, lang, source = 'src0' AS treated, n_chars::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_words, len(string_split(text, chr(10)))::DOUBLE AS n_lines FROM documents)"""


def _features(spark, d):
    return _table(spark, d, "documents").select("doc_id", "lang", (F.col("source") == "src0").alias("treated"), F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"), F.size(F.split("text", "\n")).cast("double").alias("n_lines"))


@query("SELECT lang, doc_id, control, gap FROM (SELECT t.lang, t.doc_id, c.doc_id AS control, round(" + " + ".join(f"(round(t.z_{f}, 9) - round(c.z_{f}, 9)) ** 2" for f in FEATURES) + ", 9) AS gap, row_number() OVER (PARTITION BY t.doc_id ORDER BY gap, c.doc_id) AS rn FROM z t JOIN z c ON t.lang = c.lang WHERE t.treated AND NOT c.treated) WHERE rn = 1", (DOCS, "z AS (SELECT *, " + ", ".join(f"coalesce(({f} - avg({f}) OVER (PARTITION BY lang)) / nullif(stddev_pop({f}) OVER (PARTITION BY lang), 0), 0) AS z_{f}" for f in FEATURES) + " FROM f)"))
def knn_match(spark, d):
    return matching.nearest_control(_features(spark, d), FEATURES, "lang", "doc_id", "treated")


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(g, 9) AS smd, abs(g) <= 0.1 AS balanced FROM (SELECT (avg({f}) FILTER (treated) - avg({f}) FILTER (NOT treated)) / sqrt((var_samp({f}) FILTER (treated) + var_samp({f}) FILTER (NOT treated)) / 2) AS g FROM f)" for f in FEATURES), (DOCS,))
def smd_balance(spark, d):
    return matching.smd(_features(spark, d), FEATURES, "treated")


@query("SELECT field, n_groups, round((msb - msw) / (msb + (m0 - 1) * msw), 9) AS icc, round(between / nullif(p * (1 - p) / total, 0), 9) AS design_effect FROM (SELECT field, var_samp(h / n) / count(*) AS between, sum(h) / sum(n) AS p, sum(n) AS total, count(*) AS n_groups, sum(n) / count(*)::DOUBLE AS m0, (sum(h * h / n) - sum(h) ** 2 / sum(n)) / (count(*) - 1) AS msb, (sum(h) - sum(h * h / n)) / (sum(n) - count(*)) AS msw FROM (SELECT field, person_id, sum(hit)::DOUBLE AS h, count(*)::DOUBLE AS n FROM att GROUP BY ALL) GROUP BY field)")
def icc_deff(spark, d):
    g = event_attempts(spark, d).groupBy("field", "person_id").agg(F.sum(is_hit()).cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    q = F.sum(F.col("h") * F.col("h") / F.col("n"))
    m = g.groupBy("field").agg((F.var_samp(F.col("h") / F.col("n")) / F.count("*")).alias("between"), ratio(F.sum("h"), F.sum("n")).alias("p"), F.sum("n").alias("total"), F.count("*").alias("n_groups"), ratio(F.sum("n"), F.count("*")).alias("m0"), ((q - F.sum("h") ** 2 / F.sum("n")) / (F.count("*") - 1)).alias("msb"), ((F.sum("h") - q) / (F.sum("n") - F.count("*"))).alias("msw"))
    icc = (F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("m0") - 1) * F.col("msw"))
    return m.select("field", "n_groups", r9(icc).alias("icc"), r9(F.try_divide("between", F.col("p") * (1 - F.col("p")) / F.col("total"))).alias("design_effect"))


@query()
def hungarian_match(spark, d):
    return matching.one_to_one(_features(spark, d), FEATURES, "lang", "doc_id", "treated")


@query()
def greedy_match(spark, d):
    return matching.one_to_one(_features(spark, d), FEATURES, "lang", "doc_id", "treated", optimal=False)


# ---- text -------------------------------------------------------------------------------


@query(r"SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')))", ())
def benchmark_exposure(spark, d):
    return exposure.exposed(_table(spark, d, "benchmark"), _table(spark, d, "documents"), "item_id", "doc_id")


@query(r"SELECT item_id, text FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g'))))", ())
def unexposed_controls(spark, d):
    return exposure.unexposed(_table(spark, d, "benchmark"), _table(spark, d, "documents"), "item_id", "doc_id")


@query("SELECT c_custkey, doc_id FROM (SELECT c_custkey, (1000 + c_custkey)::VARCHAR AS v FROM customer WHERE c_custkey % 7 = 0), (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS body FROM documents) WHERE contains(body, v)", ())
def number_exposure(spark, d):
    numbers = _table(spark, d, "customer").where("c_custkey % 7 = 0").select("c_custkey", F.format_string("no. %s", 1000 + F.col("c_custkey")).alias("text"))
    return exposure.exposed_numbers(numbers, _table(spark, d, "documents"), "c_custkey", "doc_id")


ASCII_PII = {"ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "card": r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}"}


def _pii(spark, d, table, key, col):
    c = F.coalesce(F.col(col), F.lit(""))
    n = {k: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0))).cast("long") for k, p in ASCII_PII.items()}
    return _table(spark, d, table).select(key, *[v.alias(k) for k, v in n.items()]).where(" + ".join(n) + " > 0")


def _pii_sql(table, key, col):
    return f"SELECT * FROM (SELECT {key}, " + ", ".join(f"len(regexp_extract_all(coalesce({col}, ''), '{p}')) AS {k}" for k, p in ASCII_PII.items()) + f" FROM {table}) WHERE " + " + ".join(ASCII_PII) + " > 0"


@query(_pii_sql("documents", "doc_id", "text"), ())
def pii_scan_documents(spark, d):
    return _pii(spark, d, "documents", "doc_id", "text")


@query(_pii_sql("pages", "page_id", "html"), ())
def pii_scan_pages(spark, d):
    return _pii(spark, d, "pages", "page_id", "html")


@query(_pii_sql("conversations", "conv_id", "text"), ())
def pii_scan_conversations(spark, d):
    return _pii(spark, d, "conversations", "conv_id", "text")


def _bank_sql(table, keys, col):
    """The same in RE2, whose classes and word bounds know ASCII only; equal on texts whose values stand beside ASCII."""
    return f"SELECT {keys}, " + ", ".join(f"len(regexp_extract_all(coalesce({col}, ''), '{p.replace(chr(39), chr(39) * 2)}'))::BIGINT AS {k}" for k, p in X.SCANNED.items()) + f" FROM {table}"


@query(_bank_sql("documents", "doc_id", "text"), ())
def pii_bank_documents(spark, d):
    return _table(spark, d, "documents").select("doc_id", *X.pii_counts(F.col("text")))


@query(_bank_sql("pages", "page_id", "html"), ())
def pii_bank_pages(spark, d):
    return _table(spark, d, "pages").select("page_id", *X.pii_counts(F.col("html")))


@query(_bank_sql("conversations", "conv_id, turn", "text"), ())
def pii_bank_conversations(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", *X.pii_counts(F.col("text")))


@query(f"SELECT value, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, rtrim(unnest(regexp_extract_all(text, '{ASCII_PII['email']}')), '.,;:)') AS value FROM documents) GROUP BY ALL", ())
def pii_value_frequency(spark, d):
    hits = _table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(ASCII_PII["email"]), F.lit(0))).alias("v"))
    return hits.select("doc_id", F.rtrim("v", F.lit(".,;:)")).alias("value")).groupBy("value").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""SELECT conv_id, turn, len(w) AS n_words, len(list_distinct(w)) AS n_unique, round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / nullif(len(w), 0), 9) AS avg_len, round(1 - len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 9) AS repetition,
  round(len(list_filter(w, lambda x: list_contains(string_split('the a an of to and in is it that for on with as at by from this be or', ' '), x)))::DOUBLE / nullif(len(w), 0), 9) AS function_share FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM conversations)""", ())
def prompt_features(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in X.prompt_features(F.col("text")).items()])


@query("SELECT round(any_value(cut), 9) AS cut, round(avg((n_chars > cut)::INT::DOUBLE) FILTER (toxic = 1), 9) AS recall, round(avg((n_chars > cut)::INT::DOUBLE) FILTER (toxic <> 1), 9) AS fpr FROM (documents JOIN labels USING (doc_id)), (SELECT quantile_cont(n_chars::DOUBLE, 0.9) AS cut FROM documents JOIN labels USING (doc_id) WHERE toxic <> 1)", ())
def threshold_filter_fpr(spark, d):
    x = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id").withColumn("positive", F.col("toxic") == 1)
    return models.threshold_filter(x, "n_chars", "positive", 0.1)


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS share FROM documents GROUP BY ALL", ())
def source_histogram(spark, d):
    by = _table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("source", "n", r9(ratio(F.col("n"), F.col("total"))).alias("share"))


@query(r"""SELECT doc_id, i - 1 AS chunk, array_to_string(p[i], ' ') AS text FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, p FROM (SELECT doc_id, list_filter(list_transform(range(0, greatest(0, (len(w) - 1) // 32) + 1), lambda j: w[j * 32 + 1:j * 32 + 32]), lambda q: len(q) >= 9) AS p FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)))""", ())
def word_chunks(spark, d):
    c = _table(spark, d, "documents").select("doc_id", F.posexplode(X.word_chunks(F.col("text"))).alias("chunk", "text"))
    return c.withColumn("chunk", F.col("chunk").cast("long"))


@query("SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, sha256(text) AS sha FROM documents", ())
def digits_and_hash(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(t, "[^0-9]", "")).cast("long").alias("n_digits"), F.sha2(t, 256).alias("sha"))


@query("""SELECT a.conv_id, a.turn, contains(lower(b.text), lower(string_split(a.text, ' ')[1])) AS hit, length(regexp_replace(a.text, '[^0-9]', '', 'g')) >= 4 AND contains(regexp_replace(b.text, '[^0-9]', '', 'g'), regexp_replace(a.text, '[^0-9]', '', 'g')) AS number_hit FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""", ())
def field_match_turns(spark, d):
    c = _table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    number = (F.length(digits("text")) >= 4) & F.contains(digits("reply"), digits("text"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.contains(F.lower("reply"), F.lower(F.split("text", " ")[0])).alias("hit"), number.alias("number_hit"))


@query(r"""SELECT conv_id, turn, x.field AS field, x.value AS value, CASE WHEN x.field = 'name' THEN trim(regexp_replace(lower(x.value), '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(lower(reply), '\s+', ' ', 'g')), trim(regexp_replace(lower(x.value), '\s+', ' ', 'g'))) ELSE length(dv) >= 4 AND contains(dr, dv) END AS v2, CASE WHEN x.field = 'name' THEN trim(regexp_replace(lower(x.value), '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(lower(reply), '\s+', ' ', 'g')), trim(regexp_replace(lower(x.value), '\s+', ' ', 'g'))) ELSE sv <> '' AND contains(sr, sv) END AS v3
  FROM (SELECT *, regexp_replace(x.value, '[^0-9]', '', 'g') AS dv, regexp_replace(reply, '[^0-9]', '', 'g') AS dr, regexp_replace(x.value, '[\s\-().]', '', 'g') AS sv, regexp_replace(reply, '[\s\-().]', '', 'g') AS sr FROM (
  SELECT a.conv_id, a.turn, b.text AS reply, unnest(list_concat([{'field': 'name', 'value': a.text}], flatten(list_transform(list_distinct(regexp_extract_all(a.text, '[0-9](?:[0-9\s\-().]*[0-9])?')), lambda n: [{'field': 'ssn', 'value': n}, {'field': 'phone', 'value': n}, {'field': 'credit_card', 'value': n}])))) AS x FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1))""", ())  # fmt: skip
def nfkc_match(spark, d):
    """Whether a turn holds the values of the turn before it: its whole text as a name, each of its numbers as every number field."""
    c = _table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\d(?:[\d\s\-().]*\d)?"), F.lit(0)))
    of = lambda field, x: F.struct(F.lit(field).alias("field"), x.alias("value"))
    values = F.concat(F.array(of("name", F.col("text"))), F.flatten(F.transform(numbers, lambda x: F.array(*[of(k, x) for k in X.NUMERIC_FIELDS]))))
    pairs = c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "reply", F.explode(values).alias("x"))
    match = lambda rule: X.field_match(F.col("x.field"), F.col("reply"), F.col("x.value"), rule)
    return pairs.select("conv_id", "turn", "x.field", "x.value", match("v2").alias("v2"), match("v3").alias("v3"))


@query()
def lcs_copy(spark, d):
    c = _table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", X.longest_common("text", "reply").alias("common"))


@query()
def text_compression(spark, d):
    return _table(spark, d, "documents").select("doc_id", X.zlib_ratio("text").alias("zlib_ratio"))


# ---- models ------------------------------------------------------------------------------


def control_targets(spark, d) -> DataFrame:
    """Thresholds of the control arm: target_membership, person_id, h, low, high."""
    k = rates.kmin(event_attempts(spark, d), GRID).where("target_membership = 'control'")
    return k.select("target_membership", "person_id", (28 + F.lit(1.5) * (F.col("person_id") % 50)).alias("h"), F.col("lower_k").cast("double").alias("low"), F.coalesce(F.col("upper_k").cast("double"), F.lit(float("inf"))).alias("high"))


@query()
def weibull_aft(spark, d):
    shards.require_formal(FORMAL_REPS, draws.SEED)
    return survival.slope_interval(control_targets(spark, d), FORMAL_REPS)

@query("SELECT capacity_k, round(max(least_), 9) AS rate FROM (SELECT i.capacity_k, a.capacity_k AS a, min(mean) AS least_ FROM curve i JOIN (SELECT a.capacity_k AS a, b.capacity_k AS b, avg(m.rate_c) AS mean FROM curve a JOIN curve b ON b.capacity_k >= a.capacity_k JOIN curve m ON m.capacity_k BETWEEN a.capacity_k AND b.capacity_k GROUP BY ALL) r ON r.a <= i.capacity_k AND r.b >= i.capacity_k JOIN curve a ON a.capacity_k = r.a GROUP BY ALL) GROUP BY 1", (ATT, CURVE))
def isotonic_curve(spark, d):
    p = rates.curve(event_attempts(spark, d)).where("capacity_k IS NOT NULL").orderBy("capacity_k").collect()
    y = [round(v, 9) for v in models.isotonic([r["rate_c"] for r in p], [1.0] * len(p))]
    return spark.createDataFrame([(r["capacity_k"], float(v)) for r, v in zip(p, y, strict=True)], "capacity_k int, rate double")


@query()
def logit_frequency(spark, d):
    att = event_attempts(spark, d).where("capacity_k > 0").select(F.log1p(F.col("capacity_k")).alias("log_k"), (F.col("target_membership") == "trained").cast("double").alias("trained"), is_hit().cast("double").alias("hit"))
    return models.logit(att, ["log_k", "trained"], "hit")


@query()
def classifier_filter(spark, d):
    c = _table(spark, d, "conversations").select("conv_id", (F.col("role") == "user").cast("int").alias("y"), *[c.alias(k) for k, c in X.prompt_features(F.col("text")).items()])
    return models.cross_validated_filter(c, ["n_words", "n_unique", "avg_len", "repetition", "function_share"], "y", "conv_id")


@query()
def anova_interaction(spark, d):
    found = models.two_way_anova(event_attempts(spark, d).withColumn("hit", is_hit().cast("double")), "target_membership", "field", "hit")
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double")


# ---- bounds, power and corpus ----------------------------------------------------------------


@query(f"""SELECT capacity_k, round(CASE WHEN m > 0 AND m <= 1 AND a < 1 THEN {bounds.z_sum()!r}::DOUBLE ** 2 * ((1 - m) / m + (2 - m) / (m * m) * a / nullif(1 - a, 0)) END, 6) AS n_needed, round((sqrt((z2 * (1 - 2 * a) / 2) ** 2 + (150 + z2) * 2 * z2 * a * (1 - a)) + z2 * (1 - 2 * a) / 2) / (150 + z2) / nullif(1 - a, 0), 9) AS detectable, round((rate_d - a) / nullif(1 - a, 0), 9) AS recall_fraction
  FROM (SELECT capacity_k, rate_c AS a, rate_d, 0.1::DOUBLE AS m, {bounds.z_sum()!r}::DOUBLE ** 2 AS z2 FROM curve)""", (ATT, CURVE))  # fmt: skip
def power_table(spark, d):
    c, z, a = rates.curve(event_attempts(spark, d)), bounds.z_sum(), F.col("rate_c")
    need = bounds.needed_n(a, F.lit(0.1), z)
    return c.select("capacity_k", F.round(F.when(need < float("inf"), need), 6).alias("n_needed"), r9(bounds.detectable(a, F.lit(150), z)).alias("detectable"), r9(bounds.recall_fraction(F.col("rate_d"), a)).alias("recall_fraction"))


@query("SELECT person_id, CAST(ceil(b / log2(50257)) AS BIGINT) AS vacuous_k, round(least(1.0::DOUBLE, 2.0::DOUBLE ** (2 * log2(50257) - b)), 9) AS counting_2, round(least(1.0::DOUBLE, 1000 * 2.0::DOUBLE ** (-b)), 9) AS blind_1000, round(least(1.0::DOUBLE, 2.0::DOUBLE ** (least(20 * log2(50257), 24) - b)), 9) AS fluent_24 FROM (SELECT DISTINCT person_id, (28 + 1.5 * (person_id % 50))::DOUBLE AS b FROM att)")
def entropy_bounds(spark, d):
    b = F.col("bits")
    p = event_attempts(spark, d).select("person_id", (28 + F.lit(1.5) * (F.col("person_id") % 50)).cast("double").alias("bits")).distinct()
    return p.select("person_id", bounds.vacuous_k(b, 50257).alias("vacuous_k"), r9(bounds.counting_bound(F.lit(2), 50257, b)).alias("counting_2"), r9(bounds.blind_bound(F.lit(1000), b)).alias("blind_1000"), r9(bounds.fluency_bound(F.lit(24.0), F.lit(20), 50257, b)).alias("fluent_24"))


@query("SELECT capacity_k, round((60 + log2(rate_c)) / capacity_k, 9) AS address_rate FROM curve WHERE capacity_k > 0 AND rate_c > 0", (ATT, CURVE))
def address_rates(spark, d):
    return bounds.address_rates(rates.curve(event_attempts(spark, d)), 60.0)


@query("SELECT count(*) AS n, round(sum(w * x * y) / nullif(sum(w * x * x), 0), 9) AS m FROM (SELECT 1 - rate_c AS x, tau AS y, 1 / (tau_hi - tau_lo) ** 2 AS w FROM curve WHERE capacity_k >= 6 AND tau_hi > tau_lo)", (ATT, CURVE))
def gap_decay(spark, d):
    return bounds.gap_decay(rates.curve(event_attempts(spark, d)))


@query("SELECT field, round((avg(final_target_nll) FILTER (target_membership = 'trained') - avg(final_target_nll) FILTER (target_membership = 'control')) / sqrt((((count(*) FILTER (target_membership = 'trained')) - 1) * var_samp(final_target_nll) FILTER (target_membership = 'trained') + ((count(*) FILTER (target_membership = 'control')) - 1) * var_samp(final_target_nll) FILTER (target_membership = 'control')) / (count(*) - 2)), 9) AS d FROM att GROUP BY ALL")
def cohen_d(spark, d):
    of = lambda arm: F.when(F.col("target_membership") == arm, F.col("final_target_nll"))
    t, c = of("trained"), of("control")
    pooled = ((F.count(t) - 1) * F.var_samp(t) + (F.count(c) - 1) * F.var_samp(c)) / (F.count("*") - 2)
    return event_attempts(spark, d).groupBy("field").agg(r9((F.avg(t) - F.avg(c)) / F.sqrt(pooled)).alias("d"))


@query(r"SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id) - 1 AS others FROM documents JOIN benchmark ON contains(trim(regexp_replace(lower(documents.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(benchmark.text), '\s+', ' ', 'g')))", ())
def random_record_match(spark, d):
    pairs = exposure.exposed(_table(spark, d, "benchmark"), _table(spark, d, "documents"), "item_id", "doc_id")
    return pairs.select("doc_id", "item_id", (F.count("*").over(Window.partitionBy("doc_id")) - 1).alias("others"))


@query(r"SELECT max(n) AS multiplicity, count(*) AS n_docs FROM (SELECT doc_id, count(*) AS n FROM documents JOIN benchmark ON contains(trim(regexp_replace(lower(documents.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(benchmark.text), '\s+', ' ', 'g'))) GROUP BY doc_id)", ())
def empirical_multiplicity(spark, d):
    n = exposure.exposed(_table(spark, d, "benchmark"), _table(spark, d, "documents"), "item_id", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("multiplicity"), F.count("*").alias("n_docs"))


@query()
def curve_families(spark, d):
    return bounds.fit_families(rates.curve(event_attempts(spark, d)))


@query()
def value_registry(spark, d):
    return corpus.value_registry(_table(spark, d, "documents"))


@query()
def synthetic_corpus(spark, d):
    n = _table(spark, d, "customer").count()
    return corpus.documents(corpus.people(spark, n, 7), corpus.scale_groups({1: 2, 5: 1, 20: 1}, n))


@query("""SELECT field, count(auc) AS reps, round(quantile_cont(auc, 0.025), 9) AS lo, round(quantile_cont(auc, 0.975), 9) AS hi FROM (
  SELECT rep, field, sum(d * (2 * below + c))::DOUBLE / (2 * sum(d) * sum(c))::DOUBLE AS auc FROM (SELECT *, coalesce(sum(c) OVER (PARTITION BY rep, field ORDER BY nll DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT rep, field, final_target_nll AS nll, sum(CASE WHEN w.target_membership = 'trained' THEN w ELSE 0 END) AS d, sum(CASE WHEN w.target_membership = 'control' THEN w ELSE 0 END) AS c FROM w JOIN att USING (target_membership, person_id) GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL""", (ATT, DRAWS))  # fmt: skip
def bootstrap_auc_ci_hash(spark, d):
    return resample.percentile_ci(ranked.auc_replicates(event_attempts(spark, d), REPS), "auc", "field")


@query("SELECT field, capacity_k, target_membership, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n, round(sum(hit) / count(*)::DOUBLE, 9) AS rate FROM att WHERE capacity_k IS NOT NULL GROUP BY ALL")
def per_field_curve(spark, d):
    return rates.rates(event_attempts(spark, d), "field", "capacity_k", "target_membership")


@query("SELECT seed, CAST(sum(hit) AS BIGINT) AS hits, count(*) AS n, round(sum(hit) / count(*)::DOUBLE, 9) AS rate FROM att WHERE target_membership = 'control' GROUP BY ALL")
def canary_rate(spark, d):
    return rates.rates(event_attempts(spark, d).where("target_membership = 'control'"), "seed")


@query("SELECT capacity_k, c_hi <= 0.5 AS floor_held, tau_lo > 0 AS signal, c_hi <= 0.5 AND tau_lo > 0 AS feasible FROM curve WHERE capacity_k IS NOT NULL", (ATT, CURVE))
def feasibility(spark, d):
    c = rates.curve(event_attempts(spark, d)).where("capacity_k IS NOT NULL")
    return c.selectExpr("capacity_k", "c_hi <= 0.5 AS floor_held", "tau_lo > 0 AS signal", "c_hi <= 0.5 AND tau_lo > 0 AS feasible")


@query("SELECT count(*) AS reps, round(quantile_cont(tau, 0.025), 9) AS lo, round(quantile_cont(tau, 0.975), 9) AS hi FROM (SELECT rep, sum(w * hd)::DOUBLE / sum(w * nd) - sum(w * hc)::DOUBLE / sum(w * nc) AS tau FROM pw JOIN ps USING (pair) GROUP BY rep)", (ATT, f"""side AS (SELECT target_membership, person_id, sum(hit) AS h, count(*) AS n, row_number() OVER (PARTITION BY target_membership ORDER BY person_id) - 1 AS pair FROM att GROUP BY 1, 2),
ps AS (SELECT a.pair, a.h AS hd, a.n AS nd, b.h AS hc, b.n AS nc FROM side a JOIN side b ON a.pair = b.pair AND a.target_membership = 'trained' AND b.target_membership = 'control'),
pw AS (SELECT rep, ('0x' || substr(md5('pair' || '|' || rep || '|' || i), 1, 8))::BIGINT % (SELECT count(*) FROM ps) AS pair, count(*) AS w FROM (SELECT pair AS i FROM ps), range({REPS}) r(rep) GROUP BY ALL)"""))  # fmt: skip
def bootstrap_pair_ci_hash(spark, d):
    return _pair_ci(spark, d, REPS)


def _pair_ci(spark, d, reps):
    att = event_attempts(spark, d)
    sums = att.groupBy("target_membership", "person_id").agg(F.sum(is_hit()).alias("h"), F.count("*").alias("n"))
    sums = ranks.numbered(sums, "person_id", "pair", "target_membership")
    side = lambda arm, x: sums.where(F.col("target_membership") == arm).select("pair", F.col("h").alias(f"h{x}"), F.col("n").alias(f"n{x}"))
    pairs = side("trained", "d").join(side("control", "c"), "pair")
    drawn = resample.drawn_rows(pairs, "pair", ["hd", "nd", "hc", "nc"], reps, "pair")
    tau = ratio(F.col("hd"), F.col("nd")) - ratio(F.col("hc"), F.col("nc"))
    return resample.percentile_ci(drawn.select("rep", tau.alias("tau")), "tau")
