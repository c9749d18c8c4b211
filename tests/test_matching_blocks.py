"""Taking turns is done by blocks of near points in many tasks; before, one task chose for a whole language."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import matching
from tests.test_matching_lists import dense


@pytest.mark.parametrize("share", [0.35, 0.6])
def test_blocks_choose_what_one_task_chose(spark, monkeypatch, share):
    """At 0.6 there are more seekers than controls, so batches follow each other."""
    for name, value in (("BLOCK", 9), ("FEW", 20), ("DEPTH", 4), ("LEAF", 2)):
        monkeypatch.setattr(matching, name, value)
    rounds, met = matching._rounds, []
    monkeypatch.setattr(matching, "_rounds", lambda *a: met.append(rounds(*a)) or met[-1])
    r = np.random.default_rng(8)
    xy = np.round(np.exp(r.normal(size=(160, 2))), 1)
    xy[:20] = xy[0]  # copies
    rows = [(int(i), "en", bool(t), *map(float, p)) for i, t, p in zip(r.permutation(len(xy)), r.random(len(xy)) < share, xy, strict=True)]
    df = spark.createDataFrame(rows, "id long, lang string, treated boolean, x double, y double").repartition(3)
    z = [tuple(row) for row in matching.standardized(df, ["x", "y"], "lang").select("id", "lang", "treated", F.round("z_x", 9), F.round("z_y", 9)).collect()]
    got = matching.one_to_one(df, ["x", "y"], "lang", "id", "treated", optimal=False).collect()
    assert {g["id"]: g["control"] for g in got if g["control"] is not None} == dense(z, False)
    assert len(got) == sum(row[2] for row in rows) and len(met) == (1 if share < 0.5 else 2)
    points = [b["n"] for c in met for b in c.groupBy("block").agg(F.countDistinct("at").alias("n")).collect()]
    assert len(points) > 3 and max(points) <= matching.BLOCK


def test_a_supplier_that_a_smaller_seeker_has_elsewhere_is_passed_over():
    assert matching.in_turn([(3, 0), (5, 1), (7, 0), (8, 1)], [[10, 11, 12], [10, 12]], {10: 4, 12: 7}) == [10, 12, 11, -1]


def test_deviations_are_made_without_sorting_a_stratum(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "lang string, x double")
    z = matching.standardized(df, ["x"], "lang")
    assert "Window" not in z._jdf.queryExecution().toString()
    assert sorted((r["lang"] or "", r["z_x"]) for r in z.collect()) == [("", -1.0), ("", 1.0), ("a", 0.0)]
