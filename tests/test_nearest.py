"""The nearest control against a comparison with every control."""

import numpy as np
import pytest

from tallyglass.operators import matching


def plain(rows, d):
    out = {}
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        x = np.array([r[3:] for r in mine], float)
        sd = x.std(axis=0)
        z = np.round(np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0), 9)
        for i, r in enumerate(mine):
            if r[2]:
                gaps = [(round(float(((z[i] - z[j]) ** 2).sum()), 9), c[0]) for j, c in enumerate(mine) if not c[2]]
                if gaps:
                    out[r[0]] = min(gaps)
    return out


@pytest.mark.parametrize("d", [1, 3])
@pytest.mark.parametrize("kind", ["even", "core and far", "ties", "one value"])
def test_nearest_control(spark, d, kind):
    r = np.random.default_rng(len(kind) + d)
    n = 240
    x = {"even": r.uniform(0, 1, (n, d)), "core and far": np.where(r.random((n, 1)) < 0.1, r.uniform(-1e4, 1e4, (n, d)), r.normal(0, 1, (n, d))), "ties": r.integers(0, 4, (n, d)).astype(float), "one value": np.ones((n, d))}[kind]
    rows = [(i, "ab"[int(r.random() < 0.2)], bool(r.random() < 0.3), *map(float, v)) for i, v in enumerate(x)] + [(n, "c", True, *[1.0] * d), (n + 1, "d", False, *[1.0] * d)]
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame(rows, "id long, lang string, treated boolean, " + ", ".join(f"{f} double" for f in names))
    got = {t.id: (t.gap, t.control) for t in matching.nearest_control(df, names, "lang", "id", "treated").collect()}
    want = plain(rows, d)
    assert set(got) == set(want)
    for k, (gap, control) in want.items():
        assert got[k][0] == pytest.approx(gap, abs=2e-9)
        assert got[k][1] == control or gap != got[k][0]
    assert matching.nearest_control(df.limit(0), names, "lang", "id", "treated").count() == 0
