"""Values in texts, against `in` for every value and text."""

import random

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import exposure, lookup, nested

SLICES = [30, 2_000_000]


def corpus(spark, seed=7):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 3)))
    texts = [(i, " ".join(word() for _ in range(r.randint(0, 12))) if i % 9 else None) for i in range(60)] + [(3, "aa bb"), (None, "a b c")]
    values = [(i, " ".join(word() for _ in range(r.randint(1, 6)))) for i in range(80)] + [(80, ""), (81, None), (82, "a"), (83, "a"), (84, "zz")]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(values, "id int, text string"), texts, values


@pytest.mark.parametrize("size", SLICES)
def test_found_values(spark, size):
    docs, values, texts, held = corpus(spark)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in lookup.found_values(docs.withColumnRenamed("text", "body"), "doc_id", "body", values, "text", size).collect())
    distinct = {v for _, v in held if v}
    assert got == sorted((i if i is not None else -1, v) for i, t in texts for v in distinct if t and v in t)
    assert lookup.slices_of(values, "text", size)[1] == -(-sum(map(len, distinct)) // size)
    assert lookup.found_values(docs.withColumnRenamed("text", "body"), "doc_id", "body", values.limit(0), "text", size).count() == 0
    assert lookup.found_values(docs.limit(0), "doc_id", "text", values.withColumnRenamed("text", "v"), "v", size).count() == 0


@pytest.mark.parametrize("size", SLICES)
@pytest.mark.parametrize("most", [0, 8])
def test_exposed_by_either_way(spark, size, most):
    docs, values, texts, held = corpus(spark)
    want = {(v, i) for v, value in held for i, t in texts if value and t and value in t}
    assert {tuple(r) for r in exposure.exposed(values, docs, "id", "doc_id", size, most).collect()} == want
    assert {r.id for r in exposure.unexposed(values, docs, "id", "doc_id").collect()} == {v for v, _ in held} - {v for v, _ in want}


def test_many_short_values(spark):
    values = spark.range(120_000).select(F.col("id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("text"))
    docs = spark.createDataFrame([(1, "see K77 and k119999."), (2, "k12"), (3, "nothing")], "doc_id long, text string")
    got = {tuple(r) for r in exposure.exposed(values, docs, "id", "doc_id", 300_000).collect()}
    assert got == {(7, 1), (77, 1), (1, 1), (11, 1), (119, 1), (1199, 1), (11999, 1), (119999, 1), (1, 2), (12, 2)}


@pytest.mark.parametrize("size", SLICES)
def test_numbers_of_any_length(spark, size):
    long = "".join(str(i % 10) for i in range(150))
    docs = spark.createDataFrame([(1, f"x {long[:70]}-{long[70:]} y"), (2, "12 34"), (3, None)], "doc_id long, text string")
    values = spark.createDataFrame([(n, long[3 : 3 + n]) for n in range(1, 120)], "id int, text string")
    got = {tuple(r) for r in exposure.exposed_numbers(values, docs, "id", "doc_id", slice_chars=size * 100).collect()}
    assert got == {(n, 1) for n in range(4, 120)}


@pytest.mark.parametrize("size", SLICES)
def test_other_records_by_comparing_all(spark, size):
    r = random.Random(3)
    name = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    values = [(p, f, name()) for p in range(12) for f in ("name", "email")] + [(3, "name", ""), (4, "name", None), (0, "ssn", "12-34"), (1, "ssn", "1 2 3 4")]
    gens = [(i, r.choice(["name", "email", "ssn", "phone"]), r.randrange(14), r.choice(["ab abba", "b", "x 12 34", "", None, "aaaa BB"])) for i in range(60)]
    digits = lambda t: "".join(c for c in t if c.isdigit())
    bare = lambda f, t: digits(t or "") if f in ("ssn", "phone") else " ".join((t or "").lower().split())
    want = {}
    for key, f, person, g in gens:
        mine = {bare(f, v) for p, field, v in values if p == person and field == f}
        want[key] = any(bare(f, v) and bare(f, v) not in mine and bare(f, v) in bare(f, g) for _, field, v in values if field == f)
    df = spark.createDataFrame(gens, "id int, field string, person int, generation string")
    got = nested.other_record_hits(df, spark.createDataFrame(values, "person int, field string, value string"), "id", size).collect()
    assert len(got) == len(gens) and {r.id: r.hit for r in got} == want
