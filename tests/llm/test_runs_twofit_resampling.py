import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyglass.llm import importance, periodic_runs, queries, two_fit_packing

FOLDER = "/root/testdata/sf0.001"
WORDS = "word_bpe_49k.json"
need_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain_runs(w, least=12):
    """(start, length, period), by comparing all words at each distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in found.items())


@st.composite
def looping(draw):
    """Words of which stretches come back."""
    out = []
    for _ in range(draw(st.integers(0, 12))):
        if out and draw(st.booleans()):
            at, n = draw(st.integers(0, len(out) - 1)), draw(st.integers(1, 30))
            out += out[at : at + n] * draw(st.integers(1, 4))
        else:
            out += draw(st.lists(st.integers(0, 3), max_size=6))
    return out[:150]


@settings(deadline=None, max_examples=300)
@given(st.lists(looping(), max_size=5), st.sampled_from([2, 3, 6, 12]))
def test_runs_like_a_comparison_at_each_distance(texts, least):
    got = periodic_runs.runs_of_texts([[str(x).encode() for x in t] for t in texts], least)
    assert got == [plain_runs(t, least) for t in texts]
    for t, runs in zip(texts, got, strict=True):
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert periodic_runs.kept_words(len(t), runs).tolist() == [i not in gone for i in range(len(t))]


def test_runs_of_words_with_known_structure(monkeypatch):
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    random.seed(3)
    texts = [list(fibonacci[-1]), ["x"] * 3000, list("abcab" * 200), [random.choice("ab") for _ in range(700)]]
    want = [plain_runs(t) for t in texts]
    assert want[1] == [(0, 3000, 1)] and want[2] == [(0, 1000, 5)]
    for pairs in (50, 1_000_000):
        monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
        assert periodic_runs.runs_of_texts([[w.encode() for w in t] for t in texts]) == want


def contract_row(key, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (key, len(runs), *([*best, 1000 * best[1] // best[2]] if best else [None] * 4), digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


@need_tables
def test_run_query_on_a_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    short = [r for r in docs if len(r.text or "") < 15_000]  # the comparison takes the square of a text
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    assert [got[r.doc_id] for r in short] == [contract_row(r.doc_id, r.text) for r in short]


def test_run_rows(spark):
    loop = "the cat\x0bsat  " * 5
    rows = [(7, loop, 1), (7, loop, 2), (None, loop, 3), (1, None, 4), (2, "", 5), (3, "no runs here", 6), (30, "a b c d e f g " * 3, 7), (11, "Same same " * 12, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    key = lambda r: tuple((v is not None, v) for v in r)
    got = [tuple(r) for r in periodic_runs.run_digests(docs).collect()]
    assert sorted(got, key=key) == sorted((contract_row(k, t) for k, t, _ in rows), key=key)
    whole = {r.doc_id: r for r in periodic_runs.find_runs(docs.where("doc_id IS NOT NULL")).collect()}
    assert whole[7].collapsed == "the cat sat" and [tuple(x) for x in whole[7].runs] == [(0, 15, 3)] and whole[11].collapsed == "Same same"
    assert periodic_runs.run_digests(docs.limit(0)).count() == periodic_runs.find_runs(docs.limit(0)).count() == 0


def plain_two_fit(sizes, capacity):
    """The same rule by search through the unpacked sizes."""
    left, out = Counter(sizes), []
    while left:
        held, room = [], capacity
        while able := [n for n in left if n <= room]:
            held.append(max(able))
            room -= held[-1]
            left = +(left - Counter(held[-1:]))
        if room and len(held) > 1:
            gap = room + held[-1]
            both = [(a + b, a, b) for a in left for b in left if b <= a and (a != b or left[a] > 1) and held[-1] < a + b <= gap]
            if both:
                _, a, b = max(both)
                left += Counter(held[-1:])
                left = +(left - Counter([a, b]))
                held[-1:] = [a, b]
        out.append(held)
    return out


@settings(deadline=None, max_examples=300)
@given(st.sampled_from([10, 30, 64]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=40))))
def test_two_fit_like_a_search_through_all_pairs(case):
    capacity, sizes = case
    got = two_fit_packing.pack(sizes, capacity)
    assert [[sizes[d] for d in s] for s in got] == plain_two_fit(sizes, capacity)
    assert sorted(d for s in got for d in s) == list(range(len(sizes)))


def test_two_documents_take_the_place_of_the_smallest():
    # greedy gives 6 + 3; without the 3 there is a gap of 4, which 2 + 2 fill
    assert [[6, 2, 2], [3]] == [sorted((([6, 3, 2, 2])[d] for d in s), reverse=True) for s in two_fit_packing.pack([6, 3, 2, 2], 10)]


def is_whole(rows, docs, capacity):
    """Every document's ids stand once, in order, and sequences have no gaps; returns how many there are."""
    tokenizer = Tokenizer.from_file(P.path(WORDS))
    want = Counter()
    for key, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        want.update((key, i, i * capacity, len(p), zlib.crc32(p)) for i, p in enumerate(parts))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values(), default=0) <= capacity
    return len(used)


@need_tables
def test_two_fit_query_on_a_whole_table(spark):
    rows = queries.op12_best_two_fit(spark, FOLDER).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    least = math.ceil(sum(r.length for r in rows) / 2048)
    assert is_whole(rows, docs, 2048) <= least + 1


def test_two_fit_rows(spark):
    docs = [(1, "a b c " * 20), (1, "a b c " * 20), (None, "x y"), (2, None), (3, ""), (3, "word " * 500), (None, None)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, offset int")
    for group in (1, 100, 10_000):
        is_whole(two_fit_packing.pack_whole(df, P.path(WORDS), 64, group_tokens=group).collect(), docs, 64)
    assert two_fit_packing.pack_whole(df.limit(0), P.path(WORDS)).count() == 0


def plain_resampling(docs, target, longest, buckets, least, share, of):
    def grams(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = "".join(c if c > "\x7f" or c.isalnum() else " " for c in low).split(" ")
        w = [x for x in w if x]
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in grams(x)[1]), Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    rows = []
    for key, x in docs:
        w, found = grams(x)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    places = {id(r): i + 1 for i, r in enumerate(able[: len(able) * share // of])}
    return [(*r[:4], places.get(id(r))) for r in rows]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))


@need_tables
def test_resampling_query_on_a_whole_table(spark):
    docs, target = (spark.read.parquet(f"{FOLDER}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = plain_resampling([(r.doc_id, r.text) for r in docs], [r.text for r in target], 1, 10_000, 20, 10, 100)
    assert in_order(queries.op13_importance_resampling(spark, FOLDER).collect()) == in_order(want)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_rows(spark, longest):
    rows = [(1, "One two ONE two \xc4pfel three"), (2, None), (3, ""), (None, "one two three one"), (4, "one-two"), (5, "x" * 2000), (5, "x" * 2000), (6, "a b a b a b c\x85d"), (7, "!?")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rank int").repartition(3)
    target = ["two one", None, "three \xc4pfel", "b a c"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, longest, 50, least_words=1, share=1, of=2)
    assert in_order(got.collect()) == in_order(plain_resampling(rows, target, longest, 50, 1, 1, 2))
    kept = importance.chosen(df, got).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in got.where("rank IS NOT NULL AND doc_id IS NOT NULL").collect()}
    assert importance.resample(df.limit(0), goal).count() == 0
    assert {r.weight for r in importance.resample(df.where("doc_id = 2"), goal.limit(0)).collect()} == {0}


def test_draw_prefers_the_target(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("alpha beta "), 20)).otherwise(F.repeat(F.lit("gamma delta "), 20)).alias("text"))
    goal = spark.createDataFrame([("alpha beta beta",)], "text string")
    got = importance.resample(docs, goal, least_words=20, share=20, of=100).where("rank IS NOT NULL").collect()
    assert len(got) == 80 and sum(r.doc_id % 4 == 0 for r in got) >= 75
