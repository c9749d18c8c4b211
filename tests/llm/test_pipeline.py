import os
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyglass.llm import quality
from tallyglass.llm.storage import table
from test_dedup import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CLASSIFY, EXACT, NEAR, PACK = (f for _, f in corpus_pipeline.STAGES)


def tail(model, text):
    """The probability of the highest grade, word by word."""
    total, n, last = 0.0, 0, None
    for word in (text or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split():
        table_, _ = quality.features([(last + b" " if last else b"").decode() + word.decode()])
        total += model.weights[table_[-1]].sum()
        n, last = n + 1, word
    score = total / max(1, n) ** quality.DAMPING
    return 1 - 1 / (1 + np.exp(score - model.thresholds[-1]))


def blanks(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_stages_like_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    model = quality.train(docs, quality.graded(table(spark, FOLDER, "labels")))
    first = CLASSIFY(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in first} == {r.doc_id for r in docs.collect() if tail(model, r.text) >= quality.LEAST}
    second = EXACT(spark, spark.createDataFrame(first, docs.schema), FOLDER).collect()
    least = {}
    for r in sorted(first, key=lambda r: r.doc_id):
        least.setdefault(blanks(r.text), r.doc_id)
    assert sorted(r.doc_id for r in second) == sorted(least.values())
    third = NEAR(spark, spark.createDataFrame(second, docs.schema), FOLDER).collect()
    assert sorted(r.doc_id for r in third) == sorted(i for i, root in brute([(r.doc_id, r.text) for r in second]).items() if i == root)
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in third}
    got, used = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == got.get(r.doc_id, 0) and r.doc_tokens == want[r.doc_id]
        got[r.doc_id] = r.start + r.length
    assert got == want
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert all(n == 1024 or n < 1024 and n & (n - 1) == 0 for n in used.values())


def test_stages_with_odd_rows(spark):
    docs = table(spark, FOLDER, "documents")
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    good = next(r.text for r in docs.orderBy(F.desc("n_chars")).collect() if len(r.text) > 2000)
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, "some words that stand alone here"), (4, good + " and more"), (5, "ab " * 400_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in names], F.lit(1).alias("norm"), F.lit(2).alias("_maybe"), F.lit(3).alias("a.b"))
    for stage in (CLASSIFY, EXACT, NEAR):
        kept = stage(spark, odd, FOLDER)
        assert kept.columns == odd.columns and kept.count() <= odd.count()
        assert stage(spark, odd.limit(0), FOLDER).count() == 0
    assert sorted((r.doc_id or 0) for r in EXACT(spark, odd, FOLDER).collect()) == [0, 1, 2, 4, 5]
    assert sorted((r.doc_id or 0) for r in NEAR(spark, odd, FOLDER).collect()) == [0, 1, 1, 2, 3, 5]
    assert {r.doc_id for r in PACK(spark, odd, FOLDER).collect()} == {None, 1, 2, 3, 4, 5} and PACK(spark, odd.limit(0), FOLDER).count() == 0
    assert CLASSIFY(spark, docs.limit(0), FOLDER).count() == 0


def test_all_columns_are_the_documents(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.subtract(docs).isEmpty()
