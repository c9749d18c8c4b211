import random

import pytest

from tallyglass.llm import exact_dedup, near_dedup
from tallyglass.llm.components import components


def shingles(text):
    import re

    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    return {d: find(d) for d in root}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("lorem ipsum dolor sit amet tempor magna aliqua enim minim veniam quis".split()) + str(r.randint(0, 40))
    rows, n = [], 0
    passage = [word() for _ in range(40)]
    for _ in range(30):
        base = [word() for _ in range(r.choice([2, 4, 5, 8, 60, 120]))]
        if r.random() < 0.4:
            base = passage + base
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_near_groups_match_brute_force(spark, monkeypatch, small):
    if small:  # forces branching, several cells of a node and several rounds of a class
        monkeypatch.setattr(near_dedup, "FEW", 1)
        monkeypatch.setattr(near_dedup, "SMALL", 3)
        monkeypatch.setattr(near_dedup, "BLOCK", 2)
        monkeypatch.setattr(near_dedup, "TOGETHER", 2)
    rows = corpus(5 + small)
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingles(dict(rows)[r.doc_id])) for r in got)


def test_one_cluster_whose_members_link_or_nearly_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 20)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(3)
    base = [f"w{r.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.choice([0, 2, 4, 5, 6, 7, 8])):
            copy[r.randrange(len(copy))] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert 1 < len(set(want.values())) < 150 and {x.doc_id: x.component_id for x in got} == want


def test_words_of_equal_polynomial_hashes(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    rows = [(1, "".join("ab"[b] for b in bits)), (2, "".join("ba"[b] for b in bits)), (3, "".join("AB"[b] for b in bits))]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("operator", [near_dedup.near_dedup, exact_dedup.exact_dedup])
def test_dedup_keeps_columns_of_any_name(spark, operator):
    names = ["_maybe", "_bucket", "_bits", "_gone", "c0", "norm", "candidate", "full", "key", "n", "bit", "a.b", "_id", "_full"]
    text = "one two three four five six seven " * 400_000
    rows = [(i, text if i < 2 else f"text {i}", *range(len(names))) for i in range(4)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{x}` int" for x in names)]))
    out = operator(df)
    assert out.columns == df.columns and sorted(tuple(r)[::2] for r in out.collect()) == [r[::2] for r in (rows[0], rows[2], rows[3])]
    assert operator(df.limit(0)).count() == 0


def test_near_groups_edge_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (4, text.upper()), (None, text), (7, None), (8, " \t"), (9, "a b"), (3, "A  b"), (5, "quite another text of seven words here"), (6, "quite another text of seven words here"), (5, text)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cls int")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()}
    assert got == {(5, 6): (4, False), (4, 6): (4, True), (None, 6): (None, True), (7, 0): (7, True), (8, 0): (8, True), (9, 1): (3, False), (3, 1): (3, True), (5, 3): (4, False), (6, 3): (4, False)}
    assert near_dedup.near_groups(df.limit(0)).count() == 0
    left = near_dedup.near_dedup(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {4, None, 7, 8, 3}


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(200, 100), (300, 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact(spark):
    rows = [(5, "a  b", 1), (3, "a b", 2), (3, "a b", 2), (None, "a\tb", 3), (None, None, 1), (9, "", 1), (1, "x", 1), (2, "x ", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == [(0, 3, 4, False), (0, 9, 2, False), (1, 1, 1, True), (2, 2, 1, True), (3, 3, 4, False), (3, 3, 4, True), (5, 3, 4, False), (9, 9, 2, True)]
    left = exact_dedup.exact_dedup(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 9]
    assert exact_dedup.exact_groups(df.limit(0)).count() == exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_refines_by_the_whole_text(spark):
    head = "the same beginning of many words " * 10
    texts = [head + "a", head + "b", head + "  a", head.replace(" ", "\n") + "a", "other" + head[5:] + "a", head + "ab", "Z" * 3_000_000 + "a", "Z" * 3_000_000 + "b"]
    df = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    first = {}
    for i, t in sorted((10 - i, t) for i, t in enumerate(texts)):
        first.setdefault(" ".join(t.split()), []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {i: (same[0], len(same), i == same[0]) for same in first.values() for i in same}
    assert {r.doc_id for r in exact_dedup.exact_dedup(df).collect()} == {same[0] for same in first.values()}
