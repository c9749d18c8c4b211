"""Matching from lists of near controls gives what comparing all rows gives."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.operators import matching


def dense(rows, optimal):
    """Total gap, and greedily each pair, by comparing all rows of one stratum."""
    t, c = [sorted(r for r in rows if r[2] is side) for side in (True, False)]
    gaps = ((np.array([r[3:] for r in t])[:, None] - np.array([r[3:] for r in c])[None]) ** 2).sum(axis=2)
    if optimal:
        few = gaps if len(t) <= len(c) else gaps.T
        return few[range(len(few)), matching.assign(few)].sum()
    free, pairs = np.ones(len(c), bool), {}
    for i in range(min(len(t), len(c))):
        j = int(np.where(free, gaps[i], np.inf).argmin())
        free[j], pairs[t[i][0]] = False, c[j][0]
    return pairs


@pytest.mark.parametrize("optimal", [True, False])
def test_lists_give_what_all_rows_give(spark, monkeypatch, optimal):
    monkeypatch.setattr(matching, "DEPTH", 1)
    monkeypatch.setattr(matching, "LEAF", 2)
    r = np.random.default_rng(5)
    rows = []
    for lang, n, share in (("en", 300, 0.45), (None, 120, 0.2), ("de", 90, 0.7)):
        xy = np.round(np.exp(r.normal(size=(n, 2))), 1)
        xy[: n // 6] = xy[0]  # copies
        rows += [(len(rows) + i, lang, bool(r.random() < share), *map(float, p)) for i, p in enumerate(xy)]
    df = spark.createDataFrame(rows, "id long, lang string, treated boolean, x double, y double")
    z = {}
    for row in matching.standardized(df, ["x", "y"], "lang").select("id", "lang", "treated", F.round("z_x", 9), F.round("z_y", 9)).collect():
        z.setdefault(row[1], []).append(tuple(row))
    got = matching.one_to_one(df, ["x", "y"], "lang", "id", "treated", optimal).collect()
    assert sorted(g["id"] for g in got) == [row[0] for row in rows if row[2]]
    used = [g["control"] for g in got if g["control"] is not None]
    assert len(used) == len(set(used)) == sum(min(sum(r[2] for r in rs), sum(not r[2] for r in rs)) for rs in z.values())
    for lang, rs in z.items():
        mine = [g for g in got if g["lang"] == lang]
        if optimal:
            assert sum(g["gap"] or 0 for g in mine) == pytest.approx(dense(rs, True), abs=1e-7)
        else:
            assert {g["id"]: g["control"] for g in mine if g["control"] is not None} == dense(rs, False)


def test_short_lists_are_told_and_full_ones_are_the_cheapest():
    r = np.random.default_rng(3)
    for n, m in ((5, 9), (30, 40), (60, 60)):
        cost = r.random((n, m)).round(1) + r.random((n, m)) * 1e-6
        best = cost[range(n), matching.assign(cost)].sum()
        for depth in (2, 6, m):
            order = np.argsort(cost, axis=1)[:, :depth]
            lists = [(o.tolist(), cost[i, o].tolist()) for i, o in enumerate(order)]
            ends = [np.inf if depth == m else c[-1] for _, c in lists]
            got, short = matching.cheapest([1] * n, lists, ends)
            if not any(short):
                assert sum(cost[i, j] for i, js in enumerate(got) for j in js) == pytest.approx(best)
        assert not any(short) and all(len(js) == 1 for js in got)


def test_a_search_stays_near(monkeypatch):
    """Before, each search read the costs of all suppliers; here seekers far from each other don't meet."""
    searched, push = [], heapq.heappush
    monkeypatch.setattr(matching.heapq, "heappush", lambda heap, x: searched.append(x) or push(heap, x))
    n = 3000
    lists = [([2 * i, 2 * i + 1, 2 * i + 2], [0.0, 1.0, 1.5]) for i in range(n)]
    got, short = matching.cheapest([1] * n, lists, [9.0] * n)
    assert [js[0] for js in got] == [2 * i for i in range(n)] and not any(short) and len(searched) <= n
