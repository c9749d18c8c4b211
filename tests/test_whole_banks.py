"""Scans and the registry take the whole banks of patterns."""

import re

from pyspark.sql import functions as F

from tallyglass.functions import text as X
from tallyglass.operators import corpus
from tallyglass.plans import catalog

TEXTS = [
    "ring +1 (017) 555-7713 or (415) 555-0182, 415.555.0182; 4155550182",
    "ssn 123-45-6789, 123 45 6789, 123456789; é123-45-6789 ١٢٣-45-6789",
    "born 1980-02-03 or 03/02/1980; card 1234 5678-9012 3456",
    "see https://a.example/x?y=1). and http://b.example, host 192.0.2.51.",
    "mail a.b@c.example, x@y.z|w and 555-7713",
    "",
    None,
]


def test_scan_counts_the_whole_bank(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string")
    for r in df.select("i", *X.pii_counts(F.col("t"))).collect():
        assert r.asDict() == {"i": r["i"]} | {k: len(re.findall(p, TEXTS[r["i"]] or "")) for k, p in X.SCANNED.items()}


def test_scan_queries_keep_every_row(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = catalog.QUERIES["pii_bank_documents"](spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert {k: r[k] for k in X.SCANNED} == {k: len(re.findall(p, texts[r["doc_id"]] or "")) for k, p in X.SCANNED.items()}
    assert sum(r["raw_phone"] for r in got) and {"phone", "date_of_birth", "url"} <= set(got[0].asDict())


def test_registry_has_all_fields(spark):
    df = spark.createDataFrame([(2, "at http://foo.example/a/b). or 1.2.3.4"), (1, "x 11.2.3.4 1.2.3.4 call (415) 555-0182, g@n.example"), (3, "1.2.3.4 " * 2), (4, None)], "doc_id long, text string")
    got = {(r["field"], r["value"]): (r["frequency"], r["first_doc"], r["context"]) for r in corpus.value_registry(df).collect()}
    assert got == {
        ("url", "http://foo.example/a/b"): (1, 2, "at "),
        ("ipv4", "1.2.3.4"): (4, 1, "x 11.2.3.4 "),
        ("ipv4", "11.2.3.4"): (1, 1, "x "),
        ("phone", "(415) 555-0182"): (1, 1, "x 11.2.3.4 1.2.3.4 call "),
        ("email", "g@n.example"): (1, 1, "x 11.2.3.4 1.2.3.4 call (415) 555-0182, "),
    }
