"""Worked values of intervals, tests and fits."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.functions import special
from tallyglass.functions.intervals import clopper_pearson, mover, wilson
from tallyglass.functions.text import common_length, field_match, regroup_digits, word_chunks
from tallyglass.operators import gates, matching, models, rates, resample, survival


def test_wilson_and_mover(spark):
    lit = F.lit
    zero, some, more = wilson(lit(0.0), lit(100 / 3)), wilson(lit(2 / 150), lit(100 / 3)), wilson(lit(2 / 150), lit(300 / 7))
    gap = mover(lit(0.0), zero, lit(0.0), zero)
    r = spark.range(1).select(zero[1], some[1], more[1], gap[0], gap[1]).first()
    assert r[0] == pytest.approx(0.1033350450, abs=1e-9)
    assert r[1] == pytest.approx(0.12598078, abs=1e-7)
    assert r[2] == pytest.approx(0.10518258, abs=1e-7)
    assert (r[3], r[4]) == pytest.approx((-0.1033350450, 0.1033350450), abs=1e-9)


def test_holm_and_envelope(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 1.0), ("c", 0.03), ("d", 0.04)], "name string, p double")
    assert {r["name"]: r["p_holm"] for r in rates.holm(tests).collect()} == pytest.approx({"a": 0.04, "b": 1.0, "c": 0.09, "d": 0.09})
    points = lambda tau: spark.createDataFrame([(k, float(t)) for k, t in zip((1, 2, 4, 8), tau, strict=True)], "capacity_k int, tau double")
    env = lambda tau: tuple(rates.peak_envelope(points(tau)).first()[1:])
    assert env([0, 0.5, 0.5, 0.1]) == (2, 4)
    assert env([0.2, 0.2, 0.2, 0.2]) == (1, 8)


def test_crossing(spark):
    p = spark.createDataFrame([(1, 0.0), (2, 0.2), (4, 0.6)], "capacity_k int, y double")
    got = {r["level"]: (r["status"], r["crossing_k"]) for r in rates.crossing(p, "y", [0.0, 0.4, 0.9]).collect()}
    assert got[0.0] == ("already_above", None) and got[0.9] == ("never", None)
    assert got[0.4][0] == "crosses" and got[0.4][1] == pytest.approx(2**1.5)


def test_special():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880348)
    assert special.f_upper(3.0, 2, 10) == pytest.approx(1.6**-5)
    assert special.mcnemar(10, 3) == pytest.approx((3.0, 0.0922851563))
    low, high = clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(1 - 0.025**0.1)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=20))
def test_isotonic_is_monotone(y):
    fit = models.isotonic(y, [1.0] * len(y))
    assert len(fit) == len(y) and all(a <= b + 1e-12 for a, b in zip(fit, fit[1:], strict=False))
    assert sum(fit) == pytest.approx(sum(y))


@settings(deadline=None, max_examples=30)
@given(st.integers(1, 5), st.integers(0, 3), st.integers(0, 10**6))
def test_assignment_is_cheapest(n, more, seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).random((n, n + more)).round(1)
    got = matching.assign(cost)
    assert len(set(got)) == n
    assert sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(n + more), n)))


def test_weibull_recovers_slope():
    random = np.random.default_rng(3)
    h = random.uniform(20, 100, 4000)
    t = np.exp(-4 + 1.7 * np.log(h) + 0.4 * np.log(-np.log(random.random(4000))))
    edges = np.concatenate(([0.0], np.geomspace(1, 400, 60)))
    at = np.searchsorted(edges, t)
    high = np.append(edges, np.inf)[np.minimum(at, len(edges))]
    theta, _ = survival.fit(h, edges[at - 1], high)
    assert theta[1] == pytest.approx(1.7, abs=0.05) and math.exp(theta[2]) == pytest.approx(0.4, abs=0.03)


def test_field_rules(spark):
    rows = [("ssn", "it is 12 3", "123"), ("ssn", "no 123-45 6789.", "123-45-6789"), ("name", "Hi  ANNA\tLee", "anna lee"), ("name", None, "x"), ("name", "abc", "")]
    df = spark.createDataFrame(rows, "field string, g string, v string")
    two, three = (field_match(F.col("field"), F.col("g"), F.col("v"), rule) for rule in ("v2", "v3"))
    got = [tuple(r) for r in df.select(two, three).collect()]
    assert got == [(False, True), (True, True), (True, True), (False, False), (False, False)]


@settings(deadline=None, max_examples=200)
@given(st.text("ab c", max_size=25), st.text("abc ", max_size=25))
def test_longest_common_run(a, b):
    runs = lambda t: {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    assert common_length(a, b) == max(map(len, runs(a) & runs(b)), default=0)


def test_quantiles(spark):
    from tallyglass.operators.ranks import quantiles

    r = np.random.default_rng(1)
    x = {g: np.round(r.normal(0, 10**g, 101 + g), 1) for g in range(3)} | {9: np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs] + [(0, None)], "g int, v double")
    for row in quantiles(df, "g", "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 1.0}).collect():
        assert row[1:] == pytest.approx(np.quantile(x[row.g], [0, 0.1, 0.5, 1]).tolist())


def test_text_helpers(spark):
    assert common_length("xabcy", "zabcq") == 3 and common_length(None, "a") == 0
    r = spark.createDataFrame([("1234567890", " ".join(f"w{i}" for i in range(41)))], "d string, t string").select(regroup_digits(F.col("d"), "phone"), word_chunks(F.col("t"))).first()
    assert r[0] == "123-456-7890" and [len(c.split()) for c in r[1]] == [32, 9]


def test_draws_keep_the_number_of_persons(spark):
    att = spark.createDataFrame([("trained" if i % 2 else "control", i) for i in range(11)], "target_membership string, person_id int")
    sums = resample.draws(att, 5).groupBy("rep", "target_membership").sum("w").collect()
    assert {r[1]: {x[2] for x in sums if x[1] == r[1]} for r in sums} == {"control": {6}, "trained": {5}}


def test_gates_raise(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    with pytest.raises(gates.GateError, match="x is set"):
        gates.require(gates.violations(df, {"x is set": F.col("x").isNotNull()}))
    gates.require(gates.violations(df.limit(0), {"x is set": F.col("x").isNotNull()}))


def test_copy_shares(spark):
    from tallyglass.operators.copying import copy_shares

    rows = [("control", 2, True, "abc def", "say ABC  def"), ("control", 2, True, "abcdef", "xxabcxx"), ("control", 4, True, "abcdef", "zz"), ("control", 4, False, "abc", "abc"), ("trained", 4, True, None, None)]
    got = {(r[0], r[1]): tuple(r[2:]) for r in copy_shares(spark.createDataFrame(rows, "target_membership string, capacity_k int, exact_match boolean, target_string string, prompt_text string")).collect()}
    assert got == {("control", 2): (2, 0.5, 0.5, 0.0), ("control", 4): (1, 0.0, 0.0, 1.0), ("trained", 4): (1, 0.0, 0.0, 1.0), (None, None): (4, 0.25, 0.25, 0.5)}


def test_curve_families_find_their_own(spark):
    from tallyglass.operators.bounds import fit_families

    rows = [(k, round(100_000 / (1 + math.exp(4 - 1.5 * math.log2(k)))), 100_000) for k in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)]
    best = fit_families(spark.createDataFrame(rows, "capacity_k int, hits_c long, n_c long")).first()
    assert best.family.startswith("logistic_log2k") and best.deviance < 1 and best.parameters[:2] == pytest.approx([-4, 1.5], abs=0.05)


def test_corpus_building(spark):
    from tallyglass.operators import corpus

    people = corpus.people(spark, 8, 3)
    docs = corpus.documents(people, corpus.scale_groups({1: 1, 3: 1}, 8))
    assert docs.count() == 4 + 12 and docs.where("text IS NULL OR text LIKE '%{%'").count() == 0
    texts = spark.createDataFrame([(1, "at 1.2.3.4 and 1.2.3.4"), (2, "1.2.3.4"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in corpus.registry(texts, r"\d\.\d\.\d\.\d").collect()] == [("1.2.3.4", 3, 1, "at ")]
    assert corpus.absent_controls(people, people.where("id < 6"), "ssn", 5).count() == 2


def test_reports(spark):
    from tallyglass.plans.reports import p_value, render

    df = spark.createDataFrame([("a_b", 0.5), (None, None)], "name string, x double")
    assert render(df) == "name  x\n-----------\na_b   0.500\n-     -".replace("-----------", "-" * len("name  x"), 1)
    assert render(df, "markdown").splitlines()[2] == "| a_b | 0.500 |" and "a\\_b & 0.500" in render(df, "latex")
    assert p_value(0.0001) == "<.001" and p_value(0.25) == ".250"
