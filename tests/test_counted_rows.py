"""Regressions pass over kept rows, and a table in one file is spread before its keys are counted."""

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import models, shards


@pytest.mark.parametrize("fit", [lambda df: models.logit(df, ["x"], "y"), lambda df: models.explained(df, ["x"], ["z"], "y")])
def test_iterations_do_not_read_the_source(spark, monkeypatch, fit):
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: read.add(1) or v, "double")
    df = spark.range(400, numPartitions=2).select(seen((F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 3).cast("double").alias("z"), (F.col("id") * 7919 % 5 > 1).cast("double").alias("y"))
    assert fit(df).count() > 1
    assert read.value <= 1200  # once to keep it, and less for a look at the outcome; each iteration was a pass before


def test_targets_of_one_partition_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shards, "SPREAD", 100)
    df = spark.range(0, 950, 1, 1).withColumnRenamed("id", "person_id")
    got = shards.spread(df, "person_id")
    assert got.rdd.getNumPartitions() == 10 and got.count() == 950


def test_fits_read_distinct_rows(spark, monkeypatch):
    met, fit = [], models._deviances
    monkeypatch.setattr(models, "_deviances", lambda df, *rest: met.append(df.count()) or fit(df, *rest))
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("z"), (F.col("id") * 7919 % 11 > 4 + F.col("id") % 7).cast("double").alias("y"))
    got = {r["model"]: r["pseudo_r2"] for r in models.explained(df, ["x"], ["z"], "y").collect()}
    assert max(met) <= 42
    s = models.GeneralizedLinearRegression(family="binomial", link="logit").fit(models.assembled(df, ["x", "z"], "y")).summary
    assert got["all"] == pytest.approx(1 - s.deviance / s.nullDeviance, rel=1e-9) and got["all"] > 0.01
    with pytest.raises(ValueError, match="vary"):
        models.explained(df.where("y = 1"), ["x"], ["z"], "y")
