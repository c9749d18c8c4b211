"""More queries of the audit engine, registered beside those of the catalog: gates, report tables, intervals, verdicts and text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import features, special, strings
from tallyglass.functions.intervals import Z95, ratio, wilson
from tallyglass.operators import corpus, draws, gates, matching, models, nested, ranked, ranks, rates, resample, shards, survival, tables, verdicts
from tallyglass.operators.rates import is_hit, r9
from tallyglass.plans.catalog import ASCII_PII, ATT, BY_REP, CURVE, DRAWS, FORMAL_REPS, KMIN, PAIRED, REPS, _table, control_targets, query
from tallyglass.sources.attempts import GRID, event_attempts, wide_attempts

WIDE = """wide AS (SELECT *, 'm' || (event_id % 2) AS model_name, CASE WHEN event_id % 50 = 7 THEN 'other' ELSE 'finetuned' END AS model_state, CASE WHEN capacity_k = 0 THEN 'fixed' ELSE 'search' END AS probe,
  CASE WHEN event_id % 5 = 0 THEN 'E1' ELSE 'E3' END AS exp_id, event_id % 41 = 0 AS random_match, CASE WHEN target_membership = 'control' THEN CASE WHEN event_id % 500 = 3 THEN 1 ELSE 0 END ELSE [1, 5, 20][(person_id // 2) % 3 + 1] END AS frequency,
  (28 + 1.5 * (person_id % 50))::DOUBLE AS bits, 10 + person_id % 9 AS len_tokens, 100 + event_id % 50 + CASE WHEN target_membership = 'trained' THEN capacity_k ELSE 0 END AS passes, target_membership || '|' || person_id || '|' || field AS target FROM att)"""
#: Attempts of which some have a score that isn't a number.
ODD = "odd AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE final_target_nll END AS final_target_nll) FROM att), scored AS (SELECT field, target_membership, final_target_nll AS nll, -final_target_nll AS s FROM odd WHERE NOT isnan(final_target_nll))"
LOG2_VOCABULARY = math.log2(50257)


def _odd(spark, d) -> DataFrame:
    return event_attempts(spark, d).withColumn("final_target_nll", F.when(F.col("event_id") % 97 == 0, float("nan")).otherwise(F.col("final_target_nll")))


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


# ---- scores ---------------------------------------------------------------------

_TPR = "round(count(*) FILTER (s >= cut AND target_membership = 'trained') / (count(*) FILTER (target_membership = 'trained'))::DOUBLE, 9)"


@query(f"SELECT a.field, round(any_value(cut), 9) AS cut, {_TPR} AS tpr, {_TPR.replace('trained', 'control')} AS fpr FROM scored a JOIN (SELECT field, s AS cut FROM (SELECT field, s, row_number() OVER (PARTITION BY field ORDER BY s) AS rn, count(*) OVER (PARTITION BY field) AS n FROM scored WHERE target_membership = 'control') WHERE rn = ceil((n - 1) * 0.95::DOUBLE) + 1) q ON a.field = q.field GROUP BY a.field", (ATT, ODD))
def tpr_with_odd_scores(spark, d):
    return ranks.tpr_at_fpr(_odd(spark, d), 0.05)


@query(f"SELECT a.field, round(any_value(cut), 9) AS cut, CASE WHEN any_value(cut) IS NOT NULL THEN {_TPR} END AS tpr, round(CASE WHEN any_value(j) >= 1 THEN any_value(j) / any_value(n)::DOUBLE END, 9) AS realised_fpr, round(1 / any_value(n)::DOUBLE, 9) AS least_fpr FROM scored a JOIN (SELECT field, any_value(n) AS n, any_value(j) AS j, max(s) FILTER (rn = j) AS cut FROM (SELECT field, s, row_number() OVER (PARTITION BY field ORDER BY s DESC) AS rn, count(*) OVER (PARTITION BY field) AS n, floor(0.02::DOUBLE * count(*) OVER (PARTITION BY field)) AS j FROM scored WHERE target_membership = 'control') GROUP BY field) q ON a.field = q.field GROUP BY a.field", (ATT, ODD))
def tpr_at_realised_fpr(spark, d):
    return ranks.tpr_at_realised_fpr(_odd(spark, d), 0.02)


@query("""SELECT field, CAST(sum(under) AS BIGINT) AS inverted, count(*) FILTER (under > 0) AS beaten, count(*) AS n_d, any_value(n_c) AS n_c, round(sum(under) / (count(*) * any_value(n_c))::DOUBLE, 9) AS share FROM (
  SELECT t.rowid_, t.field, count(c.nll) AS under, any_value(n.n) AS n_c FROM (SELECT *, row_number() OVER () AS rowid_ FROM scored WHERE target_membership = 'trained') t JOIN (SELECT field, count(*) AS n FROM scored WHERE target_membership = 'control' GROUP BY 1) n ON n.field = t.field
  LEFT JOIN scored c ON c.target_membership = 'control' AND c.field = t.field AND c.nll < t.nll GROUP BY ALL) GROUP BY field""", (ATT, ODD))  # fmt: skip
def inversions_with_odd_scores(spark, d):
    return ranks.inversions(_odd(spark, d))


# ---- gates -----------------------------------------------------------------------

SHARD_FIELDS = ["click", "view"]
_SHARD = {"rows": "(count(*) <> 100)::INT", "null outcomes": "0", "null keys": "0", "model_state is constant": "count(*) FILTER (model_state <> 'finetuned')", "probe is constant": "0", "duplicate targets": "count(*) - count(DISTINCT (target_membership, person_id, field))"}
for _side in ("trained", "control"):
    _SHARD[f"{_side} persons"] = f"((count(DISTINCT person_id) FILTER (target_membership = '{_side}')) <> 25)::INT"
    _SHARD |= {f"{_side} {f}": f"((count(*) FILTER (target_membership = '{_side}' AND field = '{f}')) <> 25)::INT" for f in SHARD_FIELDS}
_SHARD |= {"other fields": "count(*) FILTER (field NOT IN ('click', 'view'))", "controls were trained on": "count(*) FILTER (target_membership = 'control' AND frequency <> 0)"}


@query(" UNION ALL ".join(f"SELECT seed, capacity_k, '{k}' AS rule, ({v})::BIGINT AS violations FROM wide GROUP BY seed, capacity_k" for k, v in _SHARD.items()), (ATT, WIDE))
def shard_gate(spark, d):
    probe = F.when(F.col("capacity_k") == 0, "fixed").otherwise("search")
    return shards.shard_gate(wide_attempts(spark, d), 100, 25, SHARD_FIELDS, {"model_state": F.lit("finetuned"), "probe": probe})


@query("""SELECT rule, n AS violations FROM (SELECT count(*) FILTER (s IS NULL) AS missing, count(*) FILTER (f IS NULL) AS extra, count(*) FILTER (s AND f AND NOT (lo = frequency AND hi = frequency)) AS frequency, count(*) FILTER (s AND f AND (odd OR even <> sha)) AS "target string" FROM (
  SELECT target_membership, person_id, field, min(frequency) AS frequency, sha256(any_value(target)) AS sha, true AS f FROM wide WHERE seed = 0 GROUP BY ALL) a FULL JOIN (
  SELECT target_membership, person_id, field, min(frequency) AS lo, max(frequency) AS hi, any_value(person_id % 31 = 0) AS odd, sha256(any_value(target)) AS even, true AS s FROM wide WHERE seed = 1 GROUP BY ALL) b USING (target_membership, person_id, field)) UNPIVOT (n FOR rule IN (missing, extra, frequency, "target string"))""", (ATT, WIDE))  # fmt: skip
def frozen_targets(spark, d):
    w = wide_attempts(spark, d)
    frozen = w.where("seed = 0").groupBy(*shards.KEY).agg(F.min("train_frequency").alias("train_frequency"), F.min(F.sha2("target_string", 256)).alias("sha256"))
    seen = w.where("seed = 1").withColumn("target_string", F.when(F.col("person_id") % 31 == 0, "x").otherwise(F.col("target_string")))
    return shards.against_frozen(seen, frozen)


TARGETS = """targets AS (SELECT c_custkey // 2 AS pair_index, CASE WHEN c_custkey % 2 = 0 THEN 'trained' ELSE 'control' END AS target_membership, c_custkey AS person_id, field, c_custkey % 2 = 0 AND c_custkey % 97 <> 0 AS exposed, c_custkey % 89 <> 0 AS hexed, c_acctbal AS balance, length(c_name) + c_nationkey AS size,
  CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 101 = 1 THEN 1 ELSE 0 END ELSE [1, 5, 20][(c_custkey // 2) % 3 + 1] END AS frequency FROM customer, (VALUES ('ssn'), ('email')) f(field) WHERE NOT (c_custkey % 113 = 5 AND field = 'ssn')),
tiers AS (SELECT frequency, count(DISTINCT person_id) AS n FROM targets WHERE target_membership = 'trained' GROUP BY 1)"""
QUOTAS = {1: 25, 5: 25, 20: 24}


def _smd_sql(f: str) -> str:
    side = lambda fn, arm: f"{fn}({f}) FILTER (target_membership = '{arm}')"
    return f"coalesce(abs((({side('avg', 'trained')}) - ({side('avg', 'control')})) / nullif(sqrt((({side('var_samp', 'trained')}) + ({side('var_samp', 'control')})) / 2), 0)), 0) > 0.1"


@query(" UNION ALL ".join(f"SELECT '{k}' AS rule, ({v})::BIGINT AS violations FROM targets" for k, v in {
    "pair numbers": "max(pair_index) + 1 - count(DISTINCT pair_index)", "duplicate targets": "count(*) FILTER (false)", "other fields": "count(*) FILTER (false)", "controls were trained on": "count(*) FILTER (target_membership = 'control' AND frequency <> 0)",
    "hashes": "count(*) FILTER (NOT hexed)", "exposure": "count(*) FILTER (exposed <> (target_membership = 'trained'))", "balance is balanced": f"({_smd_sql('balance')})::INT", "size is balanced": f"({_smd_sql('size')})::INT",
}.items()) + """ UNION ALL SELECT 'one person of each arm', count(*) FROM (SELECT pair_index FROM targets GROUP BY 1 HAVING count(DISTINCT person_id) FILTER (target_membership = 'trained') <> 1 OR count(DISTINCT person_id) FILTER (target_membership = 'control') <> 1)
  UNION ALL SELECT 'every field', count(*) FROM (SELECT person_id FROM targets GROUP BY target_membership, person_id HAVING count(DISTINCT field) <> 2) UNION ALL SELECT 'arms are disjoint', 0
  UNION ALL SELECT 'tier quotas', count(*) FROM tiers FULL JOIN (VALUES (1, 25), (5, 25), (20, 24)) q(f, n) ON f = frequency WHERE coalesce(tiers.n, 0) <> coalesce(q.n, 0)""", (TARGETS,))  # fmt: skip
def target_contract(spark, d):
    c = _table(spark, d, "customer")
    key, trained = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    tier = F.get(F.array(F.lit(1), F.lit(5), F.lit(20)), (F.floor(key / 2) % 3).cast("int"))
    digest = lambda lead: F.sha2(F.concat(F.lit(lead), "c_name", "field"), 256)
    t = c.withColumn("field", F.explode(F.array(F.lit("ssn"), F.lit("email")))).where(~((key % 113 == 5) & (F.col("field") == "ssn"))).select(
        F.floor(key / 2).alias("pair_index"), F.when(trained, "trained").otherwise("control").alias("target_membership"), key.alias("person_id"), "field",
        F.when(trained, tier).otherwise(F.when(key % 101 == 1, 1).otherwise(0)).alias("train_frequency"),
        F.when(key % 89 == 0, F.lit("none")).otherwise(digest("v")).alias("value_sha256"), digest("f").alias("formatted_sha256"), (trained & (key % 97 != 0)).alias("exposed"),
        F.col("c_acctbal").alias("balance"), (F.length("c_name") + F.col("c_nationkey")).alias("size"),
    )
    return shards.target_contract(t, ["ssn", "email"], QUOTAS, ["balance", "size"])


MANIFESTS = """manifests AS (SELECT '{"iters":' || (CASE WHEN n_nationkey = 3 THEN 201 ELSE 200 END) || ',"code":{"commit":"abc","dirty":' || (CASE WHEN n_nationkey = 4 THEN 'true' ELSE 'false' END) || '}' || (CASE WHEN n_nationkey = 5 THEN ',"env":null' WHEN n_nationkey = 6 THEN '' ELSE ',"env":{"a":1}' END) || ',"none":null,"shard":{"seed":' || (n_nationkey % 3) || ',"capacity_k":' || (n_nationkey % 24 // 3) || '}}' AS manifest FROM nation)"""
PROVENANCE = ["iters", "code.commit", "code.dirty", "env", "none", "absent"]


def _manifests(spark, d) -> DataFrame:
    n = F.col("n_nationkey")
    text = F.concat(
        F.lit('{"iters":'), F.when(n == 3, "201").otherwise("200"), F.lit(',"code":{"commit":"abc","dirty":'), F.when(n == 4, "true").otherwise("false"), F.lit("}"),
        F.when(n == 5, ',"env":null').when(n == 6, "").otherwise(',"env":{"a":1}'), F.lit(',"none":null,"shard":{"seed":'), (n % 3).cast("string"), F.lit(',"capacity_k":'), F.floor(n % 24 / 3).cast("string"), F.lit("}}"),
    )
    return _table(spark, d, "nation").select(text.alias("manifest"))


@query(f"SELECT path, count(DISTINCT v) AS n_values, count(*) FILTER (v = '<missing>') AS n_missing, count(*) FILTER (v = 'null') AS n_null, count(DISTINCT v) = 1 AND count(*) FILTER (v IN ('<missing>', 'null')) = 0 AS ok FROM (SELECT path, coalesce(json_extract(manifest, '$.' || path)::VARCHAR, '<missing>') AS v FROM manifests, (SELECT unnest({PROVENANCE}) AS path)) GROUP BY path", (MANIFESTS,))
def manifest_invariants(spark, d):
    return gates.invariants(_manifests(spark, d), PROVENANCE)


@query("""SELECT coalesce(a.seed, b.seed) AS seed, coalesce(a.k, b.k) AS capacity_k, CASE WHEN n IS NULL THEN 'missing' WHEN b.k IS NULL THEN 'extra' ELSE 'duplicate' END AS fault FROM (SELECT (manifest->'$.shard.seed')::INT AS seed, (manifest->'$.shard.capacity_k')::INT AS k, count(*) AS n FROM manifests GROUP BY ALL) a
  FULL JOIN (SELECT s::INT AS seed, k::INT AS k FROM (SELECT unnest([0, 1]) AS s), (SELECT unnest([0, 1, 2, 9]) AS k)) b ON a.seed = b.seed AND a.k = b.k WHERE n IS NULL OR b.k IS NULL OR n > 1""", (MANIFESTS,))  # fmt: skip
def manifest_coordinates(spark, d):
    return gates.coordinates(_manifests(spark, d), [0, 1], [0, 1, 2, 9])


RECOMMENDED = {"forward_passes": "matched budgets", "prompt_text": "copy shares"}
LOG_REQUIRED = ["seed", "model_name", "model_state", "target_membership", "person_id", "field", "train_frequency", "probe", "capacity_k", "exact_match"]


@query("""SELECT * FROM (SELECT 'warning' AS level, 'missing prompt_text: disables copy shares' AS rule, 1 AS n UNION ALL SELECT 'error', 'unknown model_state', count(*) FILTER (model_state <> 'finetuned') FROM wide UNION ALL SELECT 'error', 'controls were trained on', count(*) FILTER (target_membership = 'control' AND frequency <> 0) FROM wide
  UNION ALL SELECT 'warning', 'unknown probe', count(*) FILTER (probe <> 'fixed') FROM wide UNION ALL SELECT 'warning', 'budgets of the arms differ', count(*) FROM (SELECT quantile_cont(passes, 0.5) FILTER (target_membership = 'trained') AS d, quantile_cont(passes, 0.5) FILTER (target_membership = 'control') AS c FROM wide GROUP BY model_name, model_state, probe, capacity_k) WHERE round(abs(d - c) / greatest(d, c, 1.0::DOUBLE), 9) > 0.1) WHERE n > 0""", (ATT, WIDE))  # fmt: skip
def log_report(spark, d):
    return shards.log_report(wide_attempts(spark, d), ["finetuned"], ["fixed"], LOG_REQUIRED, RECOMMENDED)


@query("SELECT frequency, person_id FROM (SELECT *, row_number() OVER (PARTITION BY frequency ORDER BY person_id) - 1 AS rn, count(*) OVER (PARTITION BY frequency) AS n FROM (SELECT DISTINCT frequency, person_id FROM wide WHERE target_membership = 'trained')) WHERE rn IN (0, n - 1)", (ATT, WIDE))
def stratified_subset(spark, d):
    people = wide_attempts(spark, d).where("target_membership = 'trained'").select(F.col("train_frequency").alias("frequency"), "person_id").distinct()
    return shards.even_places(people, "frequency", "person_id", {1: 2, 5: 2, 20: 2})


# ---- tables ------------------------------------------------------------------------


@query("SELECT 'E1' AS wanted, probe, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM wide WHERE exp_id = 'E1' GROUP BY probe UNION ALL SELECT 'E9', probe, count(*), CAST(sum(hit) AS BIGINT) FROM wide GROUP BY probe", (ATT, WIDE))
def preferred_rows(spark, d):
    w = wide_attempts(spark, d)
    of = lambda e: tables.preferred(w, F.col("exp_id") == e).groupBy(F.lit(e).alias("wanted"), "probe").agg(F.count("*").alias("n"), F.sum(is_hit()).alias("hits"))
    return of("E1").unionByName(of("E9"))


@query("SELECT target_membership || '|' || field || '|' || person_id AS target, count(*) AS n FROM att GROUP BY 1")
def target_ids(spark, d):
    return event_attempts(spark, d).groupBy(tables.target_id().alias("target")).agg(F.count("*").alias("n"))


_SIDES = "sum(hit) FILTER (target_membership = 'trained') / (count(*) FILTER (target_membership = 'trained'))::DOUBLE AS d, sum(hit) FILTER (target_membership = 'control') / (count(*) FILTER (target_membership = 'control'))::DOUBLE AS c"


@query(f"SELECT model_name, probe, field, round(d, 9) AS emr_d, round(c, 9) AS emr_c, round(d - c, 9) AS adjusted, persons, mode_k FROM (SELECT model_name, probe, field, {_SIDES}, count(DISTINCT person_id) FILTER (target_membership = 'trained') AS persons, list_sort(list_transform(map_entries(histogram(capacity_k)), lambda e: {{'v': -(e.value::BIGINT), 'k': e.key::BIGINT}}))[1].k AS mode_k FROM wide GROUP BY GROUPING SETS ((model_name, probe), (field, probe), (probe)))", (ATT, WIDE))
def membership_table(spark, d):
    return tables.membership_table(wide_attempts(spark, d), ("model_name", "probe"), ("field", "probe"), ("probe",))


@query("SELECT probe, round(avg(hit), 9) AS exact, round(avg(random_match::INT), 9) AS random, round(avg(random_match::INT) / nullif(avg(hit), 0), 9) AS ratio FROM wide GROUP BY probe", (ATT, WIDE))
def substring_guard(spark, d):
    return tables.substring_guard(wide_attempts(spark, d))


@query("SELECT capacity_k, seed, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, count(*) FILTER (random_match) AS random_matches, round(sum(hit) / count(*)::DOUBLE, 9) AS rate FROM wide GROUP BY ALL", (ATT, WIDE))
def cell_counts(spark, d):
    return tables.cells(wide_attempts(spark, d))


@query("SELECT iteration, round(rate, 9) AS rate, round(max(rate) OVER (ORDER BY iteration), 9) AS best_so_far FROM (SELECT event_id % 10 AS iteration, avg(hit) AS rate FROM att GROUP BY 1)")
def convergence(spark, d):
    return tables.convergence(event_attempts(spark, d).withColumn("iteration", F.col("event_id") % 10), "iteration")


def _kmins(spark, d) -> DataFrame:
    person = F.col("person_id")
    return rates.kmin(event_attempts(spark, d), GRID).withColumn("bits", (28 + F.lit(1.5) * (person % 50)).cast("double")).withColumn("len_tokens", 10 + person % 9)


@query("SELECT target_membership, field, count(*) AS n, round(median(k), 9) AS median_k, round(median(l), 9) AS median_len, round(CASE WHEN count(DISTINCT l) > 1 AND count(DISTINCT k) > 1 THEN corr(k, l) END, 9) AS corr FROM (SELECT target_membership, field, upper_k::DOUBLE AS k, (10 + person_id % 9)::DOUBLE AS l FROM kmin WHERE upper_k IS NOT NULL) GROUP BY ALL", (ATT, KMIN))
def copy_onset(spark, d):
    return tables.copy_onset(_kmins(spark, d))


@query(f"SELECT field, count(*) AS n, round(median(low), 9) AS median_low, round(median(high), 9) AS median_high, round(quantile_cont(low, 0.25), 9) AS q1_low, round(quantile_cont(low, 0.75), 9) AS q3_low, round(quantile_cont(low, 0.1), 9) AS p10_low, count(*) FILTER (upper_k < b / {LOG2_VOCABULARY!r}::DOUBLE) AS violating, round(min(upper_k / (b / {LOG2_VOCABULARY!r}::DOUBLE)), 9) AS least_ratio, round(median(upper_k / (b / {LOG2_VOCABULARY!r}::DOUBLE)), 9) AS median_ratio FROM (SELECT *, b / upper_k AS low, b / greatest(lower_k::DOUBLE, 1e-9::DOUBLE) AS high FROM (SELECT *, (28 + 1.5 * (person_id % 50))::DOUBLE AS b FROM kmin WHERE upper_k IS NOT NULL)) GROUP BY field", (ATT, KMIN))
def beta_brackets(spark, d):
    return tables.beta_brackets(_kmins(spark, d), LOG2_VOCABULARY)


@query("SELECT coalesce(min(step) >= 0, true) AS monotone, count(*) FILTER (step < 0) AS falls FROM (SELECT rate_c - lag(rate_c) OVER (ORDER BY capacity_k) AS step FROM curve)", (ATT, CURVE))
def monotone_floor(spark, d):
    return tables.rises(rates.curve(event_attempts(spark, d)), "capacity_k", "rate_c")


@query("SELECT rate_c, round(least(greatest(least(exp(1.0::DOUBLE) * rate_c + 1e-5::DOUBLE, 1 - (1 - 1e-5::DOUBLE - rate_c) / exp(1.0::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE), 9) AS most_tpr FROM curve", (ATT, CURVE))
def privacy_boundary(spark, d):
    return tables.privacy_boundary(rates.curve(event_attempts(spark, d)), "rate_c", 1.0, 1e-5)


@query(" UNION ALL ".join(f"SELECT 'rates.' || target_membership || '.' || capacity_k || '.{c}' AS name, ({e})::DOUBLE AS value FROM att GROUP BY target_membership, capacity_k" for c, e in (("hits", "sum(hit)"), ("n", "count(*)"), ("rate", "round(sum(hit) / count(*)::DOUBLE, 9)"))))
def number_registry(spark, d):
    return tables.numbers({"rates": rates.rates(event_attempts(spark, d), "target_membership", "capacity_k")}, {"rates": ["target_membership", "capacity_k"]})


# ---- joins --------------------------------------------------------------------------


@query("SELECT pair_index, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM att JOIN (SELECT DISTINCT person_id, target_membership, person_id // 2 AS pair_index FROM att WHERE seed = 0) USING (person_id, target_membership) GROUP BY 1")
def pair_lookup(spark, d):
    att = event_attempts(spark, d)
    frozen = att.where("seed = 0").select("person_id", "target_membership", F.floor(F.col("person_id") / 2).alias("pair_index")).distinct()
    return att.join(frozen, ["person_id", "target_membership"]).groupBy("pair_index").agg(F.count("*").alias("n"), F.sum(is_hit()).alias("hits"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'second ' || c_name END AS name FROM customer", ())
def first_file_wins(spark, d):
    c = _table(spark, d, "customer")
    first = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    second = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit("second "), "c_name").alias("name"))
    return nested.first_match([first, second], "key")


_FIRST = _squeezed("string_split(a.text, ' ')[1]")


@query(f"SELECT g.conv_id, 'name' AS field, EXISTS (SELECT 1 FROM v WHERE v.value <> '' AND v.value <> g.own AND contains(g.g, v.value)) AS hit FROM (SELECT a.conv_id, {_squeezed('b.text')} AS g, {_FIRST} AS own FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1) g", (f"v AS (SELECT DISTINCT {_FIRST} AS value FROM conversations a WHERE turn = 0)",))
def other_record_hits(spark, d):
    c = _table(spark, d, "conversations")
    values = c.where("turn = 0").select(F.col("conv_id").alias("person"), F.lit("name").alias("field"), F.split("text", " ")[0].alias("value"))
    generations = c.where("turn = 1").select("conv_id", F.lit("name").alias("field"), F.col("conv_id").alias("person"), F.col("text").alias("generation"))
    return nested.other_record_hits(generations, values, "conv_id")


@query("SELECT target_membership, person_id, field, capacity_k, round(neutral - bits, 9) AS delta_bits, round((neutral - bits) / capacity_k, 9) AS bits_per_token FROM (SELECT target_membership, person_id, field, capacity_k, arg_max(final_target_nll, event_id) AS bits FROM att WHERE capacity_k > 0 GROUP BY ALL) JOIN (SELECT target_membership, person_id, field, min(final_target_nll) AS neutral FROM att WHERE capacity_k = 0 GROUP BY ALL) USING (target_membership, person_id, field)")
def context_delta(spark, d):
    att = event_attempts(spark, d).withColumn("bits", F.col("final_target_nll")).withColumn("ord", F.col("event_id"))
    return nested.context_delta(att.where("capacity_k > 0"), att.where("capacity_k = 0"), list(shards.KEY))


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(trim(text)) >= 100", ())
def long_prompts(spark, d):
    return _table(spark, d, "conversations").where((F.col("role") == "user") & (F.length(F.trim("text")) >= 100)).select("conv_id", "turn")


# ---- nested records -------------------------------------------------------------------

RECORDS = rf"""people AS (SELECT conv_id, [1, 5, 20][conv_id % 3 + 1] AS frequency, conv_id % 5 = 0 AS neg, string_split(text, ' ')[1] AS name, string_split(text, ' ')[3] AS address, regexp_extract(text, '[0-9]{{4,}}') AS ssn FROM conversations WHERE turn = 0),
vals AS (UNPIVOT (SELECT conv_id, frequency, neg, coalesce(name, '') AS name, coalesce(address, '') AS address, coalesce(ssn, '') AS ssn FROM people) ON name, address, ssn INTO NAME field VALUE value),
records AS (SELECT v.conv_id, frequency, neg, field, bool_or(CASE WHEN field = 'ssn' THEN length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4 AND contains(regexp_replace(c.text, '[^0-9]', '', 'g'), regexp_replace(value, '[^0-9]', '', 'g')) ELSE {_squeezed('value')} <> '' AND contains({_squeezed('c.text')}, {_squeezed('value')}) END) AS hit
  FROM vals v JOIN conversations c ON c.conv_id = v.conv_id AND c.role = 'assistant' WHERE value <> '' GROUP BY ALL)"""


def _records(spark, d) -> DataFrame:
    c = _table(spark, d, "conversations").withColumn("person_name", F.col("conv_id").cast("string"))
    w = F.split("text", " ")
    first = c.where("turn = 0")
    people = first.select("person_name", F.get(w, 0).alias("name"), F.get(w, 2).alias("address"), F.regexp_extract("text", "[0-9]{4,}", 0).alias("ssn"))
    made = c.where("role = 'assistant'").groupBy("person_name").agg(F.collect_list(F.struct(F.lit("").alias("prompt"), F.col("text").alias("response"))).alias("r"))
    results = first.select("person_name", F.get(F.array(F.lit(1), F.lit(5), F.lit(20)), (F.col("conv_id") % 3).cast("int")).alias("frequency"), (F.col("conv_id") % 5 == 0).alias("is_negative_control"))
    results = results.join(made, "person_name").select("person_name", "frequency", "is_negative_control", F.create_map(F.lit("fixed"), "r").alias("methods"))
    return nested.with_person(nested.response_successes(results, nested.person_values(people)), results)


@query("SELECT CAST(sum(h) FILTER (NOT neg) AS BIGINT) AS hits, CAST(sum(n) FILTER (NOT neg) AS BIGINT) AS fields, round((sum(h) FILTER (NOT neg)) / (sum(n) FILTER (NOT neg))::DOUBLE, 9) AS rate, round(count(*) FILTER (NOT neg AND n > 0 AND h = n) / (count(*) FILTER (NOT neg))::DOUBLE, 9) AS record_rate, count(*) FILTER (NOT neg) AS persons, round((sum(h) FILTER (neg)) / (sum(n) FILTER (neg))::DOUBLE, 9) AS control_rate FROM (SELECT conv_id, neg, count(*) FILTER (field <> 'name' AND hit) AS h, count(*) FILTER (field <> 'name') AS n FROM records GROUP BY ALL)", (RECORDS,))
def headline_rates(spark, d):
    return nested.headline(_records(spark, d))


@query("SELECT what, count(*) FILTER (hit) AS hits, count(*) AS n, round(count(*) FILTER (hit) / count(*)::DOUBLE, 9) AS rate FROM (SELECT hit, 'field ' || field AS what FROM records WHERE NOT neg UNION ALL SELECT hit, 'frequency ' || frequency FROM records WHERE NOT neg AND field <> 'name' UNION ALL SELECT hit, 'category ' || CASE field WHEN 'ssn' THEN 'identity' ELSE 'contact' END FROM records WHERE NOT neg AND field <> 'name') GROUP BY what", (RECORDS,))
def success_breakdown(spark, d):
    return nested.breakdown(_records(spark, d))


_TURNS = f"SELECT b.role, b.text AS g, string_split(a.text, ' ')[1] AS v, {_FIRST} AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _variant(g: str) -> str:
    return f"round(avg((n <> '' AND contains({_squeezed(g)}, n))::INT), 9)"


@query("SELECT role, count(*) AS n, " + _variant("g") + " AS whole, " + ", ".join(rf"{_variant(f'''array_to_string(list_filter(string_split_regex(g, '{chr(92)}s+'), lambda x: x <> '')[1:{k}], ' ')''')} AS first_{k}_words" for k in (16, 32, 48, 128)) + f", round(avg((v <> '' AND contains(lower(g), lower(v)))::INT), 9) AS separators_kept, round(avg((v <> '' AND trim(g) = trim(v))::INT), 9) AS whole_output FROM ({_TURNS}) GROUP BY role", ())
def scoring_variants(spark, d):
    c = _table(spark, d, "conversations")
    b = c.select("conv_id", "role", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generation"))
    rows = c.select("conv_id", "turn", F.split("text", " ")[0].alias("value")).join(b, ["conv_id", "turn"]).withColumn("field", F.lit("name"))
    return nested.scoring_variants(rows, "role")


_SCAN = " OR ".join(f"regexp_matches(text, '{p}')" for p in ASCII_PII.values())


@query(f"SELECT role, count(*) AS n, count(*) FILTER (s) AS flagged, count(*) FILTER (k) AS leaks, count(*) FILTER (s AND k) AS caught, count(*) FILTER (k AND NOT s) AS residual, round(count(*) FILTER (k AND NOT s) / nullif(count(*) FILTER (k), 0)::DOUBLE, 9) AS residual_rate FROM (SELECT role, {_SCAN} AS s, regexp_matches(text, '[0-9]{{3}}') AS k FROM conversations) GROUP BY role", ())
def scan_residual(spark, d):
    scanned = F.greatest(*[F.regexp_like("text", F.lit(p)) for p in ASCII_PII.values()])
    return tables.catches(_table(spark, d, "conversations").select("role", scanned.alias("scanned"), F.regexp_like("text", F.lit("[0-9]{3}")).alias("leaked")), "role")


# ---- text -------------------------------------------------------------------------------


def _words_in(words: list[str]) -> str:
    return f"round(len(list_filter(w, lambda x: list_contains({words}, lower(x)))) / greatest(len(w), 1)::DOUBLE, 9)"


@query(r"""SELECT conv_id, turn, round(len(list_filter(w, lambda x: len(list_filter(w, lambda y: y = x)) > 1)) / greatest(len(w), 1)::DOUBLE, 9) AS token_repetition, """ + f"{_words_in(features.ACTION_VERBS)} AS action_verb_ratio, {_words_in(features.DOMAIN_KEYWORDS)} AS domain_keyword_density, {_words_in(features.FUNCTION_WORDS)} AS function_word_ratio" + r""",
  round(len(list_filter(w, lambda x: NOT regexp_full_match(x, '[\x00-\x7F]*') OR length(x) > 15 OR NOT regexp_matches(x, '\p{L}'))) / greatest(len(w), 1)::DOUBLE, 9) AS rare_token_ratio, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1)::DOUBLE, 9) AS avg_token_length,
  round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(len(w), 1)::DOUBLE, 9) AS unique_token_ratio, greatest(len(w), 1) AS n_tokens FROM (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations)""", ())  # fmt: skip
def prompt_signals(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", *[c.alias(k) for k, c in features.prompt_signals(F.col("text")).items()])


@query(r"""SELECT doc_id, len(w) AS n_tokens, round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / greatest(len(w), 1)::DOUBLE, 9) AS type_token_ratio, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1)::DOUBLE, 9) AS avg_token_length, round(len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}'))) / greatest(len(w), 1)::DOUBLE, 9) AS capitalised_ratio,
  round(length(regexp_replace(t, '[\p{L}\p{N}\s]', '', 'g')) / greatest(length(t), 1)::DOUBLE, 9) AS special_char_ratio, round((length(t) - length(regexp_replace(t, '\p{Nd}', '', 'g'))) / greatest(length(t), 1)::DOUBLE, 9) AS digit_ratio FROM (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)""", ())  # fmt: skip
def text_signals(spark, d):
    some = {k: c for k, c in features.text_signals(F.col("text")).items() if k not in ("compression_ratio", "entropy_estimate")}
    return _table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in some.items()])


@query(r"""SELECT c_custkey, substr(regexp_replace(lower(c_name), '[ ,]', '', 'g'), 1, 12) || '.com' AS domain, list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 1 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(reverse(card), i::INT + 1, 1)::INT + 1] ELSE substr(reverse(card), i::INT + 1, 1)::INT END)) % 10 = 0 AS luhn, c_custkey % 2 = 0 AS hexed,
  (2 * c_custkey + 8)::BIGINT AS listed, c_custkey % 3 AS seed, c_custkey % 65 AS capacity_k, substr(c_name, 1, 7) AS prefix, substr(c_name, 8) AS suffix, true AS recovered, replace(c_name, '#', '-') || '-x.y' AS safe, 'tomer' AS context FROM (SELECT *, '4' || lpad((c_custkey * 7919)::VARCHAR, 15, '0') AS card FROM customer)""", ())  # fmt: skip
def string_tools(spark, d):
    key, name = F.col("c_custkey"), F.col("c_name")
    card = F.concat(F.lit("4"), F.lpad((key * 7919).cast("string"), 15, "0"))
    digest = F.when(key % 2 == 0, F.sha2(name, 256)).otherwise(F.upper(F.sha2(name, 256)))
    stem = strings.shard_stem(F.concat(F.lit("run__E3__m_"), (key % 3).cast("string"), F.lit("_field-ssn_k"), (key % 65).cast("string"), F.lit(".parquet")))
    prefix, suffix = strings.split_at(name, F.lit(0.4))
    listed = F.aggregate(strings.int_list(F.concat(key.cast("string"), F.lit(", "), (key + 1).cast("string"), F.lit(" 7"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return _table(spark, d, "customer").select(
        "c_custkey", strings.company_domain(name).alias("domain"), strings.passes_check_digit(card).alias("luhn"), strings.is_hex_digest(digest, 64).alias("hexed"), listed.alias("listed"), stem["seed"].alias("seed"), stem["capacity_k"].alias("capacity_k"),
        prefix.alias("prefix"), suffix.alias("suffix"), strings.suffix_recovered(F.upper(name), suffix).alias("recovered"), strings.safe_name(F.concat(name, F.lit(" / x.y"))).alias("safe"), strings.context_before(name, F.lit("#"), 5).alias("context"),
    )


@query(r"""SELECT c_custkey, lower(email) AS email, CASE WHEN c_custkey % 2 = 0 THEN 'Ann Lee-Orr' ELSE 'Bo K' || c_custkey || ' Z' END AS name, CASE WHEN c_custkey % 3 = 0 THEN ['(555) 123-4567'] ELSE [] END AS phones FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Ann' || c_custkey || '@X.org' ELSE 'bo.k' || c_custkey || '_z@x.org' END AS email FROM customer) WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_custkey, NULL, NULL, CASE WHEN c_custkey % 3 = 0 THEN ['(555) 123-4567'] ELSE [] END FROM customer WHERE c_custkey % 5 = 0""", ())  # fmt: skip
def mail_headers(spark, d):
    key = F.col("c_custkey")
    n = key.cast("string")
    line = F.when(key % 5 == 0, F.lit("From: nobody")).when(key % 2 == 0, F.concat(F.lit('From: "Ann Lee-Orr" <Ann'), n, F.lit("@X.org>"))).otherwise(F.concat(F.lit("From:  bo.k"), n, F.lit("_z@x.org")))
    text = F.concat(F.lit("Subject: hello\n"), line, F.lit("\nTo: x@y.zz\n\ncall 555-1234"), F.when(key % 3 == 0, " or (555) 123-4567").otherwise(""))
    return _table(spark, d, "customer").select("c_custkey", *[c.alias(k) for k, c in strings.mail_sender(text).items()], strings.long_phones(text).alias("phones"))


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, round(log2({n}::DOUBLE), 9) AS bits" for f, n in corpus.field_supports().items()), ())
def control_entropy(spark, d):
    return spark.createDataFrame([(f, float(n)) for f, n in corpus.field_supports().items()], "field string, n double").select("field", r9(F.log2("n")).alias("bits"))


@query()
def control_people(spark, d):
    return corpus.control_people(spark, _table(spark, d, "customer").count(), 5)


# ---- resampled intervals ------------------------------------------------------------------

CI = "round(quantile_cont({0}, 0.025), 9) AS lo, round(quantile_cont({0}, 0.975), 9) AS hi"
REPS_K = BY_REP.format(k=", capacity_k")


def _own_draws(name: str, rows: str) -> str:
    return f"dw AS (SELECT rep, ('0x' || substr(md5('{name}|' || rep || '|' || i), 1, 8))::BIGINT % (SELECT count(*) FROM {rows}) AS i, count(*) AS w FROM {rows}, range({REPS}) r(rep) GROUP BY ALL)"


@query("SELECT capacity_k, count(rate) AS reps, " + CI.format("rate") + " FROM reps WHERE target_membership = 'control' GROUP BY 1", (ATT, DRAWS, REPS_K))
def bootstrap_control_curve_hash(spark, d):
    r = resample.replicates(event_attempts(spark, d), REPS, "capacity_k")
    return resample.percentile_ci(r.where("target_membership = 'control'"), "rate", "capacity_k")


@query("SELECT (SELECT count(*) FROM v) AS n, (SELECT round(avg(x), 9) FROM v) AS mean, count(*) AS reps, " + CI.format("m") + " FROM (SELECT rep, sum(w * x) / sum(w) AS m FROM dw JOIN v USING (i) GROUP BY rep)", (ATT, "v AS (SELECT row_number() OVER (ORDER BY person_id) - 1 AS i, x FROM (SELECT person_id, sum(hit) / count(*)::DOUBLE AS x FROM att GROUP BY 1))", _own_draws("mean", "v")))
def bootstrap_mean_ci_hash(spark, d):
    v = event_attempts(spark, d).groupBy("person_id").agg(ratio(F.sum(is_hit()), F.count("*")).alias("x"))
    return verdicts.mean_ci(ranks.placed(v, "i", "person_id"), "i", "x", REPS)


@query("SELECT (SELECT count(*) FROM v) AS n, (SELECT round(avg(x), 9) FROM v) AS base_rate, (SELECT round(avg(y), 9) FROM v) AS other_rate, (SELECT round(avg(y) - avg(x), 9) FROM v) AS diff, (SELECT round(avg(y) / nullif(avg(x), 0), 9) FROM v) AS ratio, round(quantile_cont(b - a, 0.025), 9) AS diff_lo, round(quantile_cont(b - a, 0.975), 9) AS diff_hi, count(b / nullif(a, 0)) AS ratios, round(quantile_cont(b / nullif(a, 0), 0.025), 9) AS ratio_lo, round(quantile_cont(b / nullif(a, 0), 0.975), 9) AS ratio_hi FROM (SELECT rep, sum(w * x)::DOUBLE / sum(w) AS a, sum(w * y)::DOUBLE / sum(w) AS b FROM dw JOIN v USING (i) GROUP BY rep)", (ATT, PAIRED, "v AS (SELECT *, row_number() OVER (ORDER BY person_id, field, seed) - 1 AS i FROM pairs)", _own_draws("paired", "v")))
def bootstrap_paired_ci_hash(spark, d):
    pairs = ranks.paired(event_attempts(spark, d), 8, 16)
    return verdicts.paired_ci(ranks.placed(pairs, "i", "person_id", "field", "seed"), "i", REPS)


@query("SELECT target_membership, capacity_k, round(rate, 9) AS rate, persons, CASE WHEN rate = 0 THEN 0.0 WHEN rate = 1 THEN round(0.025::DOUBLE ** (1.0::DOUBLE / persons), 9) ELSE lo END AS lo, CASE WHEN rate = 0 THEN round(1 - 0.025::DOUBLE ** (1.0::DOUBLE / persons), 9) WHEN rate = 1 THEN 1.0 ELSE hi END AS hi, CASE WHEN rate IN (0, 1) THEN 'exact' ELSE 'bootstrap' END AS method FROM (SELECT target_membership, capacity_k, sum(hit) / count(*)::DOUBLE AS rate, count(DISTINCT person_id) AS persons FROM att GROUP BY ALL) JOIN (SELECT target_membership, capacity_k, " + CI.format("rate") + " FROM reps GROUP BY ALL) USING (target_membership, capacity_k)", (ATT, DRAWS, REPS_K))
def cluster_rate_ci_hash(spark, d):
    return verdicts.cluster_rate_ci(event_attempts(spark, d), REPS, "capacity_k")


_FOUR = {"a": ("trained", "click"), "b": ("control", "click"), "c": ("trained", "view"), "d": ("control", "view")}
_CONTRASTS = {"tau_first": "a - b", "tau_second": "c - d", "did": "(a - b) - (c - d)", "shift_c": "b - d"}
_MEANS = ", ".join(f"sum({{w}}h{k})::DOUBLE / nullif(sum({{w}}n{k}), 0) AS {k}" for k in _FOUR)


@query("SELECT p.name, round(p.value, 9) AS point, q.lo, q.hi FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, {e} AS value FROM (SELECT {_MEANS.format(w='')} FROM v)" for k, e in _CONTRASTS.items()) + ") p JOIN (SELECT name, " + CI.format("value") + " FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, {e} AS value FROM bm" for k, e in _CONTRASTS.items()) + ") GROUP BY name) q USING (name)", (ATT, "v AS (SELECT *, row_number() OVER (ORDER BY pair) - 1 AS i FROM (SELECT person_id // 2 AS pair, " + ", ".join(f"coalesce(sum(hit) FILTER (target_membership = '{a}' AND field = '{f}'), 0) AS h{k}, count(*) FILTER (target_membership = '{a}' AND field = '{f}') AS n{k}" for k, (a, f) in _FOUR.items()) + " FROM att GROUP BY 1))", _own_draws("cube", "v"), f"bm AS (SELECT rep, {_MEANS.format(w='w * ')} FROM dw JOIN v USING (i) GROUP BY rep)"))
def bootstrap_cube_ci_hash(spark, d):
    return verdicts.paired_cells_ci(event_attempts(spark, d), REPS, "click", "view", F.floor(F.col("person_id") / 2))


@query("SELECT field, count(tpr) AS reps, " + CI.format("tpr") + """ FROM (SELECT rep, field, sum(CASE WHEN s >= cut THEN d ELSE 0 END)::DOUBLE / sum(d) AS tpr FROM (SELECT *, min(CASE WHEN c > 0 AND upto > ceil((n_c - 1) * 0.9::DOUBLE) THEN s END) OVER (PARTITION BY rep, field) AS cut FROM (
  SELECT *, sum(c) OVER (PARTITION BY rep, field ORDER BY s) AS upto, sum(c) OVER (PARTITION BY rep, field) AS n_c FROM (SELECT rep, field, -final_target_nll AS s, sum(CASE WHEN w.target_membership = 'trained' THEN w ELSE 0 END) AS d, sum(CASE WHEN w.target_membership = 'control' THEN w ELSE 0 END) AS c FROM w JOIN att USING (target_membership, person_id) GROUP BY ALL))) GROUP BY ALL) GROUP BY field""", (ATT, DRAWS))  # fmt: skip
def bootstrap_tpr_ci_hash(spark, d):
    return resample.percentile_ci(ranked.tpr_replicates(event_attempts(spark, d), REPS, 0.1), "tpr", "field")


@query("SELECT level, count(k) AS reps, " + CI.format("k") + """ FROM (SELECT rep, level, 2 ** (arg_min(x0 + (level - y0) / (y - y0) * (x - x0), capacity_k) FILTER (y0 < level AND y >= level)) AS k FROM (SELECT *, lag(x) OVER o AS x0, lag(y) OVER o AS y0 FROM (
  SELECT rep, capacity_k, log2(capacity_k) AS x, rate AS y, level FROM reps, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS level) WHERE target_membership = 'control' AND capacity_k > 0) WINDOW o AS (PARTITION BY rep, level ORDER BY capacity_k)) GROUP BY ALL) GROUP BY level""", (ATT, DRAWS, REPS_K))  # fmt: skip
def bootstrap_quantile_ci_hash(spark, d):
    r = resample.replicates(event_attempts(spark, d), REPS, "capacity_k").where("target_membership = 'control'")
    return resample.percentile_ci(verdicts.crossing_replicates(r, [0.25, 0.5, 0.75]), "k", "level")


_RANK = "rank() OVER (PARTITION BY rep ORDER BY {0}) + (count(*) OVER (PARTITION BY rep, {0}) - 1) / 2.0::DOUBLE"


@query(f"SELECT count(rho) AS valid, {CI.format('rho')}, round((count(*) FILTER (rho <= 0) + 1) / (count(rho) + 1)::DOUBLE, 9) AS p FROM (SELECT rep, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM (SELECT rep, {_RANK.format('capacity_k')} AS rx, {_RANK.format('rate')} AS ry FROM reps WHERE target_membership = 'control' AND capacity_k > 0) GROUP BY rep)", (ATT, DRAWS, REPS_K))
def floor_trend_hash(spark, d):
    rho = verdicts.rank_trend(resample.replicates(event_attempts(spark, d), REPS, "capacity_k").where("target_membership = 'control'"))
    q = lambda p: r9(F.percentile("rho", F.lit(p)))
    return rho.agg(F.count("rho").alias("valid"), q(0.025).alias("lo"), q(0.975).alias("hi"), r9((F.count_if(F.col("rho") <= 0) + 1) / (F.count("rho") + 1)).alias("p"))


_WEIGHTS = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in verdicts.quadratic_weights(GRID).items())


@query(f"SELECT count(*) AS reps, round(quantile_cont(earliest, 0.025), 9) AS lo, round(quantile_cont(latest, 0.975), 9) AS hi, count(*) FILTER (ties > 1) AS tied, round(quantile_cont(quadratic, 0.025), 9) AS quadratic_lo, round(quantile_cont(quadratic, 0.975), 9) AS quadratic_hi FROM (SELECT rep, min(capacity_k) FILTER (tau >= top - 1e-12) AS earliest, max(capacity_k) FILTER (tau >= top - 1e-12) AS latest, count(*) FILTER (tau >= top - 1e-12) AS ties, sum(tau * weight) AS quadratic FROM (SELECT a.rep, a.capacity_k, a.rate - b.rate AS tau, max(a.rate - b.rate) OVER (PARTITION BY a.rep) AS top FROM reps a JOIN reps b ON a.rep = b.rep AND a.capacity_k = b.capacity_k WHERE a.target_membership = 'trained' AND b.target_membership = 'control' AND a.capacity_k > 0) JOIN (VALUES {_WEIGHTS}) w(capacity_k, weight) USING (capacity_k) GROUP BY rep)", (ATT, DRAWS, REPS_K))
def peak_envelope_hash(spark, d):
    r = resample.replicates(event_attempts(spark, d), REPS, "capacity_k")
    one = lambda arm, name: r.where(F.col("target_membership") == arm).select("rep", "capacity_k", F.col("rate").alias(name))
    tau = one("trained", "x").join(one("control", "y"), ["rep", "capacity_k"]).withColumn("tau", F.col("x") - F.col("y"))
    q = lambda c, p: r9(F.percentile(c, F.lit(p)))
    return verdicts.peaks(tau, GRID).agg(F.count("*").alias("reps"), q("earliest", 0.025).alias("lo"), q("latest", 0.975).alias("hi"), F.count_if(F.col("ties") > 1).alias("tied"), q("quadratic", 0.025).alias("quadratic_lo"), q("quadratic", 0.975).alias("quadratic_hi"))


@query()
def curve_verdicts(spark, d):
    return verdicts.curve_verdicts(event_attempts(spark, d), FORMAL_REPS, GRID, 20, targets=control_targets(spark, d), formal=True)


@query("SELECT target_membership, field, round(rate, 9) AS rate, persons, CASE WHEN rate = 0 THEN 0.0 WHEN rate = 1 THEN round(0.025::DOUBLE ** (1.0::DOUBLE / persons), 9) ELSE lo END AS lo, CASE WHEN rate = 0 THEN round(1 - 0.025::DOUBLE ** (1.0::DOUBLE / persons), 9) WHEN rate = 1 THEN 1.0 ELSE hi END AS hi, CASE WHEN rate IN (0, 1) THEN 'exact' ELSE 'bootstrap' END AS method FROM (SELECT target_membership, field, sum(hit) / count(*)::DOUBLE AS rate, count(DISTINCT person_id) AS persons FROM att GROUP BY ALL) JOIN (SELECT target_membership, field, " + CI.format("rate") + " FROM reps GROUP BY ALL) USING (target_membership, field)", (ATT, DRAWS, BY_REP.format(k=", field")))
def per_field_ci_hash(spark, d):
    return verdicts.cluster_rate_ci(event_attempts(spark, d), REPS, "field")


@query("SELECT n, b, c, round(least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM range(0, least(b, c) + 1) t(i))), 9) AS p FROM (SELECT (b + c)::DOUBLE AS n, b, c FROM (SELECT count(*) FILTER (x = 1 AND y = 0) AS b, count(*) FILTER (x = 0 AND y = 1) AS c FROM pairs))", (ATT, PAIRED))
def mcnemar_exact(spark, d):
    r = ranks.discordant(ranks.paired(event_attempts(spark, d), 8, 16)).first()
    p = special.binomial_two_sided_half(r["b"], r["b"] + r["c"])
    return spark.createDataFrame([(float(r["b"] + r["c"]), r["b"], r["c"], round(p, 9))], "n double, b long, c long, p double")


@query("SELECT capacity_k, round(greatest(0, m - h), 9) AS lo, round(least(1, m + h), 9) AS hi FROM (SELECT capacity_k, (p + z * z / (2 * e)) / (1 + z * z / e) AS m, z / (1 + z * z / e) * sqrt(p * (1 - p) / e + z * z / (4 * e * e)) AS h FROM (SELECT capacity_k, sum(hit) / count(*)::DOUBLE AS p, count(*) / 1.5::DOUBLE AS e, " + repr(Z95) + "::DOUBLE AS z FROM att WHERE target_membership = 'control' GROUP BY 1))")
def wilson_effective_n(spark, d):
    by = event_attempts(spark, d).where("target_membership = 'control'").groupBy("capacity_k").agg(ratio(F.sum(is_hit()), F.count("*")).alias("p"), (F.count("*") / F.lit(1.5)).alias("e"))
    lo, hi = wilson(F.col("p"), F.col("e"))
    return by.select("capacity_k", r9(lo).alias("lo"), r9(hi).alias("hi"))


@query("SELECT 'balance' AS feature, count(*) AS n, round(avg(a.c_acctbal - b.c_acctbal) / stddev_samp(a.c_acctbal - b.c_acctbal), 9) AS smd FROM customer a JOIN customer b ON a.c_custkey % 2 = 0 AND b.c_custkey = a.c_custkey + 1", ())
def paired_balance(spark, d):
    c = _table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 2).alias("pair"), (F.col("c_custkey") % 2).alias("side"), "c_acctbal")
    side = lambda i, name: c.where(F.col("side") == i).select("pair", F.col("c_acctbal").alias(name))
    return matching.paired_smd(side(0, "a").join(side(1, "b"), "pair"), {"balance": ("a", "b")})


@query()
def lognormal_aft(spark, d):
    shards.require_formal(FORMAL_REPS, draws.SEED)
    return survival.slope_interval(control_targets(spark, d), FORMAL_REPS, "lognormal")


@query()
def top_predictors(spark, d):
    x = wide_attempts(spark, d).select(is_hit().cast("double").alias("hit"), F.log1p(F.col("capacity_k").cast("double")).alias("log_k"), F.col("len_tokens").cast("double").alias("len_tokens"), F.log1p(F.col("train_frequency").cast("double")).alias("log_frequency"))
    return models.top_terms(models.logit(x, ["log_k", "len_tokens", "log_frequency"], "hit"), 2)


# ---- models -----------------------------------------------------------------------------------


@query()
def frequency_response(spark, d):
    return models.frequency_response(wide_attempts(spark, d), "search")


@query()
def explained_hits(spark, d):
    x = wide_attempts(spark, d).where("target_membership = 'trained'").select(is_hit().cast("double").alias("hit"), F.log1p(F.col("train_frequency").cast("double")).alias("log_frequency"), F.col("len_tokens").cast("double").alias("len_tokens"), "bits")
    return models.explained(x, ["log_frequency"], ["len_tokens", "bits"], "hit")


@query()
def forest_filter(spark, d):
    names = list(features.prompt_signals(F.lit("")))
    x = _table(spark, d, "conversations").select("conv_id", (F.col("role") == "user").cast("int").alias("y"), *[c.alias(k) for k, c in features.prompt_signals(F.col("text")).items()])
    x = ranks.kept(x)  # a forest reads its rows many times
    held = F.pmod(F.xxhash64("conv_id"), F.lit(5)) == 0
    return models.forest_filter(x.where(~held), x.where(held), names, "y", trees=20)


@query()
def curve_correlations(spark, d):
    return models.correlations(rates.curve(event_attempts(spark, d)), "capacity_k", "rate_c")
