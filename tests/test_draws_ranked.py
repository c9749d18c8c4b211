"""Rank statistics of replicates against every score copied as often as its person is drawn."""

import hashlib
import math

import numpy as np
import pytest

from tallyglass.operators import draws, ranked, resample
from tallyglass.plans import catalog, formal

assert formal  # adds its queries
PERSONS = {"trained": 41, "control": 57}


def attempts(spark):
    random = np.random.default_rng(5)
    rows = [(arm, person, "ab"[person % 2], float(round(random.exponential(8), 0))) for arm, n in PERSONS.items() for person in range(n) for _ in range(4)]
    rows += [("trained", 3, "a", math.nan), ("control", 4, "a", None), ("control", 5, "b", math.inf)]
    return rows, spark.createDataFrame(rows, "target_membership string, person_id long, field string, final_target_nll double")


def by_seed(arm, rep):
    return draws.block_counts(draws.SEED, arm, rep, PERSONS[arm], 0)


def by_hash(arm, rep):
    n = PERSONS[arm]
    return np.bincount([int(hashlib.md5(f"{arm}|{rep}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)], minlength=n)


def scores(rows, field, rep, counts):
    kept = [r for r in rows if r[2] == field and r[3] is not None and not math.isnan(r[3])]
    return [np.repeat([-r[3] for r in kept if r[0] == arm], [counts(arm, rep)[r[1]] for r in kept if r[0] == arm]) for arm in ("trained", "control")]


@pytest.mark.parametrize(("seed", "counts"), [(draws.SEED, by_seed), (None, by_hash)])
def test_auc_and_tpr_of_each_replicate(spark, seed, counts, monkeypatch):
    monkeypatch.setattr(ranked, "BANDS", 5)
    rows, att = attempts(spark)
    auc = {(r.rep, r.field): r.auc for r in ranked.auc_replicates(att, 60, seed=seed).collect()}
    tpr = {(r.rep, r.field): r.tpr for r in ranked.tpr_replicates(att, 60, 0.1, seed=seed).collect()}
    assert len(auc) == len(tpr) == 120
    for rep in range(60):
        for field in "ab":
            d, c = scores(rows, field, rep, counts)
            assert auc[rep, field] == pytest.approx(np.mean((d[:, None] > c) + 0.5 * (d[:, None] == c)))
            assert tpr[rep, field] == pytest.approx(np.mean(d >= np.sort(c)[math.ceil((len(c) - 1) * 0.9)]))


@pytest.mark.parametrize("name", ["auc", "tpr"])
def test_formal_rank_intervals_share_the_registered_draw(spark, name, monkeypatch):
    asked = []
    monkeypatch.setattr(ranked, f"{name}_replicates", lambda att, reps, *a, seed=None: asked.append((reps, seed)) or att.selectExpr("field", f"0.5D AS {name}"))
    catalog.QUERIES[f"bootstrap_{name}_ci_formal"](spark, "/root/testdata/sf0.001")
    assert asked == [(2_000, draws.SEED)]


def test_packed_draws_in_blocks(spark):
    at = spark.createDataFrame([(arm, i, n) for arm, n in PERSONS.items() for i in range(n)], "target_membership string, place long, persons long")
    got = {(r.target_membership, r.block, r.chunk): draws.unpacked(bytes(r.drawn), 7) for r in draws.hash_counts(at, 10, 7, size=16).collect()}
    assert max(b for _, b, _ in got) == 3 and {c for _, _, c in got} == {0, 1}
    for arm, n in PERSONS.items():
        for rep in range(10):
            mine = np.concatenate([got[arm, b, rep // 7][:, rep % 7] for b in range(4) if (arm, b, rep // 7) in got])
            assert mine[:n].tolist() == by_hash(arm, rep).tolist()


def test_counts_are_multiplied_not_joined(spark):
    """No row stands for a draw: packed counts of a block meet its persons' sums."""
    _, att = attempts(spark)
    r = resample.replicates(att.selectExpr("*", "final_target_nll > 5 AS exact_match"), 200)
    assert r.count() == 400
    plan = r._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "md5" not in plan


def test_draws_as_rows(spark):
    persons = spark.createDataFrame([(arm, i) for arm, n in PERSONS.items() for i in range(n)], "target_membership string, person_id long")
    got = {(r.target_membership, r.rep, r.person_id): r.w for r in resample.draws(persons, 3).collect()}
    assert got == {(arm, rep, i): w for arm in PERSONS for rep in range(3) for i, w in enumerate(by_hash(arm, rep).tolist()) if w}
