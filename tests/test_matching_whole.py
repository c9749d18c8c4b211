"""Matching is done over the whole field, and every treated row is returned."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import matching
from tallyglass.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["hungarian_match", "greedy_match"])
def test_every_treated_document_is_matched(spark, name):
    docs = spark.read.parquet(f"{D}/documents.parquet").groupBy("lang").agg(F.count_if(F.col("source") == "src0").alias("t"), F.count_if(F.col("source") != "src0").alias("c")).collect()
    got = catalog.QUERIES[name](spark, D).collect()
    assert len(got) == sum(r["t"] for r in docs)
    matched = [r["control"] for r in got if r["control"] is not None]
    assert len(matched) == len(set(matched)) == sum(min(r["t"], r["c"]) for r in docs)


def frame(spark, treated, controls):
    rows = [(i, "en", True, float(x)) for i, x in enumerate(treated)] + [(100 + i, "en", False, float(x)) for i, x in enumerate(controls)]
    return spark.createDataFrame(rows, "id long, lang string, treated boolean, x double")


def test_distant_rows_match_and_the_total_is_least(spark):
    df = frame(spark, [199, 25000, 8000], [200, 230, 9000, 7000, 12000])
    z = {r["id"]: r["z_x"] for r in matching.standardized(df, ["x"], "lang").collect()}
    got = {r["id"]: r for r in matching.one_to_one(df, ["x"], "lang", "id", "treated").collect()}
    best = min(sum((z[i] - z[c]) ** 2 for i, c in enumerate(p)) for p in permutations(range(100, 105), 3))
    assert sum(r["gap"] for r in got.values()) == pytest.approx(best, abs=1e-6)
    greedy = {r["id"]: r["control"] for r in matching.one_to_one(df, ["x"], "lang", "id", "treated", optimal=False).collect()}
    assert greedy == {0: 100, 1: 104, 2: 102}


@pytest.mark.parametrize("optimal", [True, False])
def test_treated_rows_without_a_control_are_returned(spark, optimal):
    got = matching.one_to_one(frame(spark, [1, 50, 2], [2, 51]), ["x"], "lang", "id", "treated", optimal).collect()
    assert len(got) == 3 and sorted(r["control"] or 0 for r in got) == [0, 100, 101]
    assert all((r["gap"] is None) == (r["control"] is None) for r in got)
    alone = matching.one_to_one(frame(spark, [1, 5], []), ["x"], "lang", "id", "treated", optimal).collect()
    assert [(r["control"], r["gap"]) for r in alone] == [(None, None)] * 2
