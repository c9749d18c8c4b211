"""What a text's features and chunks are made from is made once, and digests are whole."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from tallyglass.functions import features
from tallyglass.functions.text import word_chunks
from tallyglass.operators import models
from tallyglass.plans import audit, catalog, limits

assert audit and limits  # they add their queries


def test_features_of_a_long_prompt(spark):
    text = " ".join(f"w{i % 4000} Ärger show" for i in range(4000))
    started = time.time()
    r = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in features.prompt_signals(F.col("t")).items()]).first()
    assert time.time() - started < 15  # sorting for each token takes minutes
    assert (r.n_tokens, r.token_repetition, r.action_verb_ratio) == (12000, pytest.approx(2 / 3, abs=1e-8), pytest.approx(1 / 3, abs=1e-8))
    assert (r.rare_token_ratio, r.unique_token_ratio) == (pytest.approx(1 / 3, abs=1e-8), pytest.approx(4002 / 12000, abs=1e-8))


def test_chunks_of_a_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    started = time.time()
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(word_chunks(F.col("t")).alias("c")).first().c
    assert time.time() - started < 15  # splitting for each chunk takes longer
    assert got == [" ".join(words[i : i + 32]) for i in range(0, 60_000, 32)]


def test_forest_reads_features_that_are_kept(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "forest_filter", lambda df, held, *a, **k: seen.extend([df, held]) or df)
    catalog.QUERIES["forest_filter"](spark, "/root/testdata/sf0.001")
    plans = [df._jdf.queryExecution().withCachedData().toString() for df in seen]
    assert len(plans) == 2 and all("InMemoryRelation" in p or "RDD" in p for p in plans)


def test_digest_of_more_rows_than_a_range(spark, tmp_path):
    n = 70_000
    spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = [f'["{i}","{sha(f"t{i}" if i % 9 else "")}"]' for i in sorted(range(n), key=str)]
    r = catalog.QUERIES["corpus_digest"](spark, str(tmp_path)).first()
    assert (r.what, r.n, r.sha256) == ("documents", n, sha("[" + ",".join(lines) + "]"))
