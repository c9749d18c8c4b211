"""The threshold fit gives the point, interval and p of all the replicates that its decision needs."""

import math

import numpy as np
import pytest

from tallyglass.operators import survival
from tallyglass.plans import catalog, formal

assert formal  # adds its queries


def test_registered_fit_runs_all_replicates(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(survival, "slope_interval", lambda t, reps, *a: asked.append(reps) or t)
    catalog.QUERIES["weibull_aft"](spark, "/root/testdata/sf0.001")
    assert asked == [10_000]


def test_interval_and_p(spark):
    random, inf = np.random.default_rng(3), math.inf
    h = np.repeat(random.uniform(20, 60, 60), 2)
    t = np.exp(-4 + 1.7 * np.log(h) + 0.4 * np.log(-np.log(random.random(120))))
    edges = np.array([0.0, 1, 2, 4, 8, 16, 24, 32])
    at = np.searchsorted(edges, t)
    low, high = edges[at - 1], np.append(edges, inf)[at]
    df = spark.createDataFrame([(i // 2, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(h, low, high, strict=True))], "person_id long, h double, low double, high double")
    r = survival.slope_interval(df, 200).first()
    theta, _ = survival.fit(h, low, high)
    slopes = []
    for rep in range(200):
        times = np.bincount(np.random.default_rng([20240601, rep]).integers(0, 60, 60), minlength=60)
        slopes.append(survival.fit(h, low, high, np.repeat(times, 2).astype(float), start=theta)[0][1])
    assert (r["n"], r["reps"]) == (120, 200) and (r["intercept"], r["slope"], r["log_scale"]) == pytest.approx(tuple(theta), abs=1e-5)
    assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.percentile(slopes, [2.5, 97.5])), abs=1e-5)
    assert r["p"] == pytest.approx((sum(abs(s - theta[1]) >= abs(theta[1] - 1) - 1e-12 for s in slopes) + 1) / 201, abs=1e-9)


@pytest.mark.parametrize(("name", "reps"), [("rate", 10_000), ("pair", 10_000), ("auc", 2_000)])
def test_intervals_rest_on_all_replicates(spark, name, reps):
    got = catalog.QUERIES[f"bootstrap_{name}_ci_formal"](spark, "/root/testdata/sf0.001").collect()
    assert got and {r["reps"] for r in got} == {reps} and all(r["lo"] <= r["hi"] for r in got)
