import functools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.llm import ann, context_tree, license_scan, quality
from tallyglass.llm.html_main import extract_main, main_text


def brute_scores(train, test, depth):
    """The same model from the definition: one recursion over all contexts seen."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    norm = lambda t: b" ".join((t or "").encode().translate(low).split()) + b"\n"
    path = lambda b: [((1 << k) | b >> 8 - k, b >> 7 - k & 1) for k in range(8)]
    counts = {}
    for t in train:
        s = b"\n" * depth + norm(t)
        for i in range(depth, len(s)):
            for node, bit in path(s[i]):
                for d in range(depth + 1):
                    counts.setdefault((node, s[i - d : i]), [0, 0])[bit] += 1
    children = {}
    for node, context in counts:
        if context:
            children.setdefault((node, context[1:]), []).append((node, context))
    block = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def weighted(n):
        own = block(*counts[n])
        return own if len(n[1]) == depth else float(np.logaddexp(own, sum(map(weighted, children.get(n, [])))) - math.log(2))

    out = []
    for t in test:
        s, total = b"\n" * depth + norm(t), 0.0
        for i in range(depth, len(s)):
            for node, bit in path(s[i]):
                p = 0.5
                for d in range(depth, -1, -1):
                    n = (node, s[i - d : i])
                    c = counts.get(n, [0, 0])
                    share = 1.0 if d == depth else 0.5 if n not in counts else 1 / (1 + math.exp(min(700, sum(map(weighted, children.get(n, []))) - block(*c))))
                    p = share * (c[bit] + 0.5) / (sum(c) + 1) + (1 - share) * p
                total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("group_bytes", [40, 10**9])
def test_context_tree(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(context_tree, "GROUP_BYTES", group_bytes)
    r = random.Random(2)
    texts = [" ".join(r.choice(["The", "cat", "sat", "on", "mät", "zz", "a\t"]) for _ in range(r.randint(1, 12))) for _ in range(40)] + ["", None, " \n", "The cat"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "cat", 1)]
    got = context_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score int")).toPandas()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t, _ in rows if not held(i)]
    want = {i: s for (i, _, _), s in zip(rows, brute_scores(train, [t for _, t, _ in rows], context_tree.DEPTH), strict=True)}
    tokens = [[*(t or "").lower().split(), None] for t in train]
    counts = {}
    for w in (w for t in tokens for w in t):
        counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for row in got.itertuples():
        i = None if row.doc_id != row.doc_id else int(row.doc_id)
        mine = [*(dict((a, b) for a, b, _ in rows)[i] or "").lower().split(), None]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held(i), len(mine), sum(w in counts for w in mine), n)
        assert row.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in mine))
        assert row.score == pytest.approx(want[i], rel=1e-5)


def test_context_tree_without_rows(spark):
    assert context_tree.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_neighbours(spark):
    random_ = np.random.default_rng(1)
    x = random_.normal(size=(1500, 16)).astype("f4")
    x[700:1100] = x[5]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(1500, None), (1600, [0.0] * 16), (1700, [float("nan")] * 16), (1800, [None] + [1.0] * 15), (1900, [1.0] * 3), (200, [float(a) for a in x[200]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = ann.search(df, F.col("vec_id") % 100 == 0).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        gap = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        gap[q] = np.inf
        order = np.lexsort((np.arange(1500), gap))[:10]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and q not in set(g["vec_id"])
        assert g["score"].to_numpy() == pytest.approx(gap[g["vec_id"].to_numpy()])
        hits += len(set(g["vec_id"]) & set(order.tolist()))
        total += 10
    assert set(got["query_id"]) == set(range(0, 1500, 100)) and hits / total >= 0.95
    few = spark.createDataFrame([(100, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(few, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1, 2.0)]
    assert ann.search(few.limit(0), F.lit(True)).count() == 0


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License. UNDER the mit-license!"),
        (2, "x Apache License, Version 2.0 (CC BY-NC 4.0)"),
        (3, "Permission is hereby granted, free of charge, to anyone who gets a copy; any person obtaining a copy of this software and associated documentation files (the Software) to deal in the Software without restriction"),
        (4, None), (4, ""), (5, "cc by nd, the mit under"), (None, "cc by nc"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (2, 1, 5, "mit", 1.0)
    assert (got[2].base_labels, got[2].n_base, got[2].first_word, got[2].last_word) == ("apache-2,cc-by-nc", 2, 1, 6)
    assert got[3].base_labels == "" and got[3].labels == "mit" and 0.6 <= got[3].score < 1
    assert (got[4].n_words, got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, 0, None, "", 0.0)
    assert got[5].labels == "" and got[None].labels == "cc-by-nc"
    assert license_scan.scan_licenses(df).count() == 7 and license_scan.scan_licenses(df.limit(0)).count() == 0


def test_quality(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    docs, ratings = [], []
    for i in range(900):
        words = [word() for _ in range(r.randint(20, 200))]
        rating = 2
        if i % 5 == 0:
            rating, words = 0, [w + "%%%" for w in words]
        elif i % 5 == 1:
            rating = 1
            for _ in range(5):
                words.insert(r.randrange(len(words)), r.choice(["rotten", "vile"]))
        docs.append((i, " ".join(words), 1))
        ratings.append((i, rating))
    d = spark.createDataFrame(docs, "doc_id long, text string, score int")
    y = spark.createDataFrame([*ratings[:600], (1, None), (None, 1)], "doc_id long, rating int")
    model = quality.train(d, y)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {x.doc_id: x for x in quality.score(d, model).collect()}
    right = [got[i].accepted == (k == 2) for i, k in ratings[600:]]
    assert sum(right) / len(right) > 0.95
    assert np.mean([got[i].expected_grade for i, k in ratings if k == 0]) < np.mean([got[i].expected_grade for i, k in ratings if k == 2])
    kept = quality.select(d, model)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i in got if got[i].accepted}
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a b")], "doc_id long, text string")
    assert quality.score(odd, model).count() == 3 and quality.score(odd.limit(0), model).count() == 0
    assert set(quality.train(odd, y.limit(0)).weights) == {0.0}


def test_ordinal_slopes_and_fit():
    r = np.random.default_rng(5)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def likelihood(y, s, cut):
        edges = np.concatenate(([-np.inf], cut, [np.inf]))
        return np.log(sig(edges[y + 1] - s) - sig(edges[y] - s)).sum()

    y, s, cut = r.integers(0, 4, 30), r.normal(size=30), np.array([-1.0, 0.2, 1.5])
    by_score, by_cut = quality.slopes(y, s, cut)
    for got, at in ((by_score, s), (by_cut, cut)):
        for i in range(len(at)):
            step = np.zeros(len(at))
            step[i] = 1e-5
            pair = [likelihood(y, *((s + d, cut) if at is s else (s, cut + d))) for d in (step, -step)]
            assert got[i] == pytest.approx((pair[0] - pair[1]) / 2e-5, rel=1e-4, abs=1e-6)
    x = r.normal(size=(1500, 3))
    truth = x @ [1.5, -1.0, 0.5] + r.logistic(size=1500)
    y = np.digitize(truth, [-1.0, 1.0])
    index, counts = np.tile(np.arange(1, 4), 1500), np.full(1500, 3)
    model = quality.fit(index, x.ravel(), counts, y, epochs=60, decay=0.0)
    w, cut = np.zeros(3), np.array([-1.0, 1.0])
    for _ in range(3000):  # plain gradient ascent over all rows
        by_score, by_cut = quality.slopes(y, x @ w, cut)
        w, cut = w + 2 * x.T @ by_score / 1500, cut + 2 * by_cut / 1500
    assert likelihood(y, x @ model.weights[1:4], model.thresholds) > likelihood(y, x @ w, cut) - 5
    assert model.weights[1:4] == pytest.approx(w, abs=0.15)


def test_quality_learns_from_bounded_rows(spark, monkeypatch):
    rows = [(i, f"good text {i} " * 20 if i % 2 else f"bad! {i} " * 20, 1) for i in range(40)]
    docs = spark.createDataFrame([*rows, *[(1, "bad! one", 1)] * 500, (3, None, 2)], "doc_id long, text string, rating int")
    ratings = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, rating int")
    whole = quality.train(docs, ratings)
    assert whole.grades == [0, 1] and whole.weights.any()
    monkeypatch.setattr(quality, "MOST", 1)
    assert not quality.train(docs, ratings).weights.any()
    monkeypatch.setattr(quality, "MOST", 200)
    assert quality.train(docs, ratings).grades


def test_html(spark):
    page = '<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><div id="main"><div class="post"><h1>T &amp; U</h1><p>Hello, a  b\nc<br>line two<ul><li>one<li>two</ul><script>var x = "<p>";</script></div><div class=comments><p>bad, bad, bad, bad comment that is long enough to score</div></div><form>x<input></form><footer>f'
    assert main_text(page) == "T & U\nHello, a b c\nline two\none\ntwo"
    assert main_text("only &lt;text&gt;") == "only <text>" and main_text("<p></p>") == "" and main_text(None) == ""
    assert main_text("<p>unclosed <b>bold</p></i></div> tail") == "unclosed bold\ntail"
    df = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2)], "page_id long, url string, html string, text int")
    assert {(r.page_id, r.url, r.n_chars) for r in extract_main(df).collect()} == {(1, "u", 35), (2, None, 0)}
    assert extract_main(df.limit(0)).count() == 0


def test_long_texts_and_columns_of_any_name(spark):
    long = "Under the MIT License, good words. " * 60_000
    rows = [(1, long, 1), (2, "short text", 1), (1, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, value int").select("*", *[F.lit(1).alias(c) for c in ("row", "grp", "keys", "words", "w", "held_out", "label", "index")])
    got = license_scan.scan_licenses(df).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base) for r in got) == [(1, 360_000, 60_000)] * 2 + [(2, 2, 0)]
    scores = context_tree.score_documents(df).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in scores) == [(1, 360_001)] * 2 + [(2, 3)] and scores[0].score < 0
    model = quality.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, rating int"))
    assert quality.score(df, model).count() == 3
    html = "<article>" + "<p>word, " * 100_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", html), (1, "u", html)], "page_id long, url string, html string").withColumn("n_chars", F.lit(1))
    assert [r.n_chars for r in extract_main(pages).collect()] == [6 * 100_000 - 1] * 2


def test_equal_polynomial_hashes_in_scores(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    rows = [(0, "".join("ab"[b] for b in bits)), (1, "".join("ba"[b] for b in bits))]
    learn = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = {r.doc_id: r.n_known for r in context_tree.score_documents(spark.createDataFrame([(learn, rows[0][1]), (held, rows[1][1])], "doc_id long, text string")).collect()}
    assert got == {learn: 2, held: 1}
