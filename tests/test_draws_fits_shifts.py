import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyglass.functions import optimise
from tallyglass.operators import bounds, draws, entropy, shifts, survival, verdicts
from tallyglass.operators.gates import GateError
from test_audit import fixture

INF = math.inf
#: Published thresholds (h, low, high) of 50 targets, two of each of 25 persons.
# fmt: off
PUBLISHED = [
    (63.5946274, 6, 8), (72.7373734, 8, 12), (73.2488785, 6, 8), (71.0573578, 6, 8), (61.9390678, 3, 4), (73.3539886, 8, 12), (81.8055420, 6, 8),
    (77.9754486, 16, 20), (58.1386871, 4, 6), (75.6232224, 12, 16), (89.2885208, 8, 12), (72.9158249, 6, 8), (69.2617340, 8, 12), (74.5090714, 8, 12),
    (70.1283417, 4, 6), (71.7736511, 8, 12), (75.3119965, 6, 8), (73.6006012, 8, 12), (59.0126953, 4, 6), (72.0927124, 20, 24), (58.8847847, 4, 6),
    (72.7672348, 12, 16), (68.7743912, 6, 8), (70.9929276, 8, 12), (77.1939697, 4, 6), (66.7834854, 12, 16), (63.8598061, 4, 6), (73.2622375, 12, 16),
    (64.1964417, 4, 6), (74.8741608, 8, 12), (76.3058701, 4, 6), (72.6956940, 6, 8), (90.4914169, 6, 8), (75.4841156, 8, 12), (80.7545166, 8, 12),
    (72.4435577, 8, 12), (71.4271622, 6, 8), (74.5890656, 8, 12), (76.1542358, 6, 8), (73.6038895, 6, 8), (56.2680435, 4, 6), (78.0916367, 8, 12),
    (65.2461853, 4, 6), (74.7577057, 12, 16), (69.5932846, 4, 6), (71.6410980, 6, 8), (67.4320374, 4, 6), (79.0307846, 8, 12), (57.3024712, 4, 6),
    (75.2242661, 12, 16)
]
# fmt: on


def test_published_slope():
    h, low, high = (np.array(c, float) for c in zip(*PUBLISHED, strict=True))
    theta, value = survival.fit(h, low, high)
    assert theta[1] == pytest.approx(2.46939, abs=1e-5) and math.exp(theta[2]) < 1
    other, _ = survival.fit(h, low, high, family="lognormal")
    assert other[1] == pytest.approx(2.00646, abs=1e-5)
    for family, best in (("weibull", theta), ("lognormal", other)):  # a plain search finds nothing better
        at = bounds.simplex_search(lambda t, f=family: -survival.log_likelihood(t, h, low, high, np.ones(50), f), list(best + 0.1))
        assert at == pytest.approx(best, abs=1e-4)


@pytest.mark.parametrize("family", ["weibull", "lognormal"])
@pytest.mark.parametrize(("h", "low", "high"), [
    ([20, 30, 40], [0, 0, 0], [1, 2, 4]),  # left-censored alone: the likelihood has no maximum
    ([28] * 6, [1, 2, 4, 1, 2, 8], [2, 4, 8, 2, 4, INF]),  # one h: no slope
    ([20, 30, 40], [8, 8, 8], [INF] * 3),  # right-censored alone
    ([20, 30], [2, 4], [2, 8]), ([0, 30], [2, 4], [4, 8]), ([], [], []),
])
def test_fits_that_fail_raise(family, h, low, high):
    with pytest.raises(survival.FitError):
        survival.fit(np.array(h, float), np.array(low, float), np.array(high, float), family=family)


@pytest.mark.parametrize("family", ["weibull", "lognormal"])
def test_gradients(family):
    random = np.random.default_rng(5)
    low = random.choice([0.0, 1, 2, 4, 8], 40)
    high = np.where(random.random(40) < 0.2, INF, low + random.choice([1.0, 3, 9], 40))
    f = survival._Likelihood(random.uniform(20, 60, 40), low, high, random.integers(0, 3, (1, 40)).astype(float), family, 3.6)
    none = np.zeros(1, int)
    for at in ([1.0, 1.0, -0.5], [3.0, -2.0, 0.7], [0.2, 4.0, -1.5]):
        x = np.array([at])
        for i in range(3):
            by = np.eye(3)[i] * 1e-6
            assert f(x, none)[1][0, i] == pytest.approx(float((f(x + by, none)[0] - f(x - by, none)[0])[0]) / 2e-6, rel=1e-4, abs=1e-5)


def test_a_second_start_is_taken_and_counted(monkeypatch):
    h, low, high = (np.array(c, float) for c in zip(*PUBLISHED, strict=True))
    want = survival.fit(h, low, high)[0]
    calls = []

    def faulty(f, start, *bounds_):
        x, value, solved = optimise.minimise(f, start, *bounds_)
        calls.append(len(start))
        return x, value, solved & (np.arange(len(start)) > 0) if len(calls) == 1 else solved

    monkeypatch.setattr(survival, "minimise", faulty)
    theta, _, again = survival.fit_many(h, low, high, np.ones((3, 50)), "weibull", want)
    assert calls == [3, 1] and again.tolist() == [True, False, False] and theta == pytest.approx(np.tile(want, (3, 1)), abs=1e-5)


def test_many_problems_at_once():
    """Rosenbrock's valley from many starts, with and without a bound in the way."""

    def f(x, which):
        a, b = x[:, 0], x[:, 1]
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.stack([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)], axis=1)

    start = np.random.default_rng(1).uniform(-2, 2, (50, 2))
    x, value, solved = optimise.minimise(f, start, np.array([-5.0, -5]), np.array([5.0, 5]))
    assert solved.all() and np.abs(x - 1).max() < 1e-5
    x, _, solved = optimise.minimise(f, start, np.array([-5.0, -5]), np.array([0.5, 5]))
    assert solved.all() and x == pytest.approx(np.tile([0.5, 0.25], (50, 1)), abs=1e-6)
    assert optimise.well_determined(np.array([[[2.0, 0], [0, 1]], [[1, 1], [1, 1]], [[1, 0], [0, 0]]])).tolist() == [True, False, False]


def test_draws_are_whole_and_repeat():
    for persons, size in ((1, 4), (7, 4), (8, 4), (9, 100)):
        blocks = -(-persons // size)
        for rep in range(30):
            counts = [draws.block_counts(3, "control", rep, persons, b, size) for b in range(blocks)]
            assert sum(map(len, counts)) == persons == sum(c.sum() for c in counts)
            assert all((c == draws.block_counts(3, "control", rep, persons, b, size)).all() for b, c in enumerate(counts))
    means = np.mean([np.concatenate([draws.block_counts(3, "x", r, 10, b, 4) for b in range(3)]) for r in range(3000)], axis=0)
    assert np.abs(means - 1).max() < 0.1  # every person is drawn as often


@pytest.mark.parametrize("size", [3, 4096])
def test_drawn_sums_like_numpy(spark, monkeypatch, size):
    monkeypatch.setattr(draws, "CHUNK", 7)
    rows = [(arm, p, cell, float((p * 7 + len(cell)) % 5)) for arm in ("control", "trained") for p in range(8) for cell in ("a", "bb", "ccc") if (p + len(cell)) % 4]
    df = spark.createDataFrame(rows, "target_membership string, person_id long, cell string, v double")
    at = draws.places(df)
    parts = draws.drawn_sums(df, at, ["cell"], ["v"], 20, 5, size=size)
    got = {(r.target_membership, r.rep, r.cell): r.v for r in draws.by_replicate(parts, ["target_membership", "chunk", "cell"], ["v"]).collect()}
    for arm in ("control", "trained"):
        for rep in range(20):
            w = np.concatenate([draws.block_counts(5, arm, rep, 8, b, size) for b in range(-(-8 // size))])
            for cell in ("a", "bb", "ccc"):
                assert got[arm, rep, cell] == pytest.approx(sum(w[p] * v for a, p, c, v in rows if a == arm and c == cell))


def targets_of(spark):
    h, low, high = (list(map(float, c)) for c in zip(*PUBLISHED, strict=True))
    return spark.createDataFrame([("control", f"control-{i // 2:02d}", *r) for i, r in enumerate(zip(h, low, high, strict=True))], "target_membership string, person_id string, h double, low double, high double")


def test_one_draw_for_the_family(spark):
    att, grid = fixture(spark)
    got = {r.name: r for r in verdicts.curve_verdicts(att, 500, grid, 20, targets=targets_of(spark)).collect()}
    assert set(got) == {"H1", "H2", "H3", "H4", "H5"} and got["H4"].point == pytest.approx(2.46939, abs=1e-5)
    assert got["H4"].lo < got["H4"].point < got["H4"].hi
    ps = sorted(got[n].p for n in ("H1", "H2", "H3", "H4"))
    assert got["H4"].p_holm >= got["H4"].p and got["H1"].p_holm == pytest.approx(4 * ps[0]) and got["H2"].p_holm == 1.0
    # H4's refits use the same persons as the curve's control replicates
    h, low, high = (np.array(c, float) for c in zip(*PUBLISHED, strict=True))
    point = survival.fit(h, low, high)[0]
    slopes = [survival.fit(h, low, high, np.repeat(draws.block_counts(draws.SEED, "control", r, 25, 0), 2).astype(float), start=point)[0][1] for r in range(500)]
    assert (got["H4"].lo, got["H4"].hi) == pytest.approx(tuple(np.percentile(slopes, [2.5, 97.5])), abs=1e-5)
    rates = {(r.rep, r.capacity_k): r.rate for r in draws.rate_replicates(att, 20, "capacity_k").where("target_membership = 'control'").collect()}
    hits = {}
    for r in att.where("target_membership = 'control'").groupBy("person_id", "capacity_k").agg(F.sum(F.col("exact_match").cast("int")).alias("h")).collect():
        hits[r.person_id, r.capacity_k] = r.h
    for rep in range(20):
        w = draws.block_counts(draws.SEED, "control", rep, 25, 0)
        assert rates[rep, 20] == pytest.approx(sum(w[p] * hits[f"control-{p:02d}", 20] for p in range(25)) / (6 * 25))


def test_formal_runs_have_the_registered_replicates(spark):
    att, grid = fixture(spark)
    with pytest.raises(GateError, match="registered"):
        verdicts.curve_verdicts(att, 2_000, grid, 20, formal=True)
    with pytest.raises(GateError, match="registered"):
        verdicts.curve_verdicts(att, 10_000, grid, 20, seed=1, formal=True)


def test_field_points(spark):
    rows = [(arm, 1, "ssn", 4, i < hits) for arm, hits in (("trained", 6), ("control", 2)) for i in range(10)] + [("control", 2, "ssn", 8, True), ("trained", 2, "ssn", 8, False)]
    att = spark.createDataFrame(rows, "target_membership string, person_id long, field string, capacity_k int, exact_match boolean")
    got = {r.capacity_k: r for r in verdicts.field_points(att).collect()}
    m = (0.6 - 0.2) / 0.8
    assert got[4].m == pytest.approx(m) and got[4].m_se == pytest.approx(math.sqrt(0.24 / 10 + (1 - m) ** 2 * 0.16 / 10) / 0.8)
    assert got[8].m is None and got[8].m_se is None and got[8].tau == -1


def curve_counts(shift, width=0.8, top=0.9, n=400, seed=2):
    k = np.array([1.0, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64])
    rate = lambda place: top * np.exp(-np.exp(-(np.log2(k) - place) / width))
    random = np.random.default_rng(seed)
    return k, random.binomial(n, rate(3.0)), np.full(len(k), n), random.binomial(n, rate(3.0 - shift)), np.full(len(k), n)


def test_shift_like_a_search(spark):
    k, hc, nc, hd, nd = curve_counts(0.4)
    got = {n: float(v[0]) for n, v in shifts.fit_shift(k, hc, nc, hd, nd).items()}
    x = np.log2(k)

    def nll(place, width, top, h, n):
        p = np.clip(top * np.exp(-np.exp(-(x - place) / width)), 1e-12, 1 - 1e-12)
        return float(-(h * np.log(p) + (n - h) * np.log(1 - p)).sum())

    ok = lambda t: 0 < t[-1] <= 1 and min(t[2:-1]) > 0
    shared = lambda t: nll(t[0], t[2], t[3], hc, nc) + nll(t[1], t[2], t[3], hd, nd) if ok(t) else 1e12
    free = lambda t: nll(t[0], t[2], t[4], hc, nc) + nll(t[1], t[3], t[4], hd, nd) if ok(t) else 1e12
    a, b = bounds.simplex_search(shared, [3.0, 2.9, 0.7, 0.85]), bounds.simplex_search(free, [3.0, 2.9, 0.7, 0.7, 0.85])
    assert got["nll_shared"] == pytest.approx(shared(a), abs=1e-4) and got["nll_free"] == pytest.approx(free(b), abs=1e-4)
    assert (got["place_control"], got["place_trained"], got["width"], got["ceiling"]) == pytest.approx(tuple(a), abs=2e-3)
    half = lambda place: 2 ** (place - got["width"] * math.log(math.log(2)))
    assert got["shift_tokens"] == pytest.approx(half(got["place_control"]) - half(got["place_trained"])) and got["lr"] == pytest.approx(2 * (shared(a) - free(b)), abs=1e-3)
    at = got["k50_control"]
    assert got["ceiling"] / 2 == pytest.approx(got["ceiling"] * math.exp(-math.exp(-(math.log2(at) - got["place_control"]) / got["width"])))
    assert got["lr_p"] == pytest.approx(math.erfc(math.sqrt(got["lr"] / 2)))
    points = spark.createDataFrame([(0, 0, 9, 0, 9), *[tuple(map(int, r)) for r in zip(k, hc, nc, hd, nd, strict=True)]], "capacity_k int, hits_c int, n_c int, hits_d int, n_d int")
    assert shifts.horizontal_shift(points).first()["shift_factor"] == pytest.approx(got["shift_factor"])
    grid = shifts.likelihood_grid(points, [2.5, 3.0], [0.8], [0.9]).collect()
    assert {(r.arm, r.place): r.nll for r in grid} == {(arm, p): pytest.approx(nll(p, 0.8, 0.9, h, n)) for arm, h, n in (("control", hc, nc), ("trained", hd, nd)) for p in (2.5, 3.0)}
    best = shifts.grid_fit(shifts.likelihood_grid(points, [2.5, 2.75, 3.0], [0.6, 0.8], [0.8, 0.9, 1.0])).first()
    assert best["nll"] >= got["nll_shared"] - 1e-6 and best["lr"] >= 0


def test_shift_replicates_and_no_curve(spark):
    att, grid = fixture(spark)
    got = shifts.shift_replicates(att, 300).agg(F.count("shift_tokens").alias("n"), F.min("shift_tokens").alias("lo"), F.avg("shift_factor").alias("f"), F.min("lr").alias("lr")).first()
    assert got["n"] == 300 and got["f"] > 1 and got["lr"] >= 0  # trained targets are hit a step earlier
    with pytest.raises(shifts.ShiftError):
        shifts.fit_shift(np.array([1.0, 2]), [0, 1], [0, 0], [0, 1], [1, 1])


def test_quantile_ratio(spark):
    c = spark.createDataFrame([("ssn", 0.25, 4.0), ("ssn", 0.5, 8.0), ("ssn", 0.75, 20.0), ("email", 0.25, 3.0)], "field string, level double, k double")
    b = spark.createDataFrame([("ssn", 28.0), ("email", 60.0)], "field string, bits double")
    got = {r.field: r for r in bounds.quantile_ratio(c, b, "field").collect()}
    assert (got["ssn"].k75_over_k25, got["ssn"].bits_per_token) == (5.0, 3.5) and got["email"].k75_over_k25 is None


def test_email_entropy_by_a_plain_product(spark):
    first = {"Ann": 2, "ANN": 1, "Zoë": 3, "Mary-Lou": 1, "O'Brien": 1, None: 4}
    last = {"obrien": 1, "OBrien": 1, "St. John": 2, "Ann": 1}
    f, el = (spark.createDataFrame(list(d.items()), "name string, w long") for d in (first, last))
    domains = spark.createDataFrame([("a.com", 1), ("b.com", 3)], "name string, w long")
    masses = entropy.local_masses(entropy.weights(f, "name", "w"), entropy.weights(el, "name", "w"))
    plain = lambda t: t.lower().replace("ë", "e").replace("'", "").replace(" ", "-")
    want, share = {}, 0.0
    for shape in entropy.LOCAL_PARTS:
        values = 100.0 if "##" in shape else 26.0 if "?" in shape else 1.0
        for a, pa in first.items() if "{first}" in shape else [("", None)]:
            for b, pb in last.items() if "{last}" in shape else [("", None)]:
                if a is None:
                    continue
                p = (1.0 if pa is None else pa / 8) * (1.0 if pb is None else pb / 5) / 4
                key = plain(shape.replace("{first}", a).replace("{last}", b).replace("#", "0").replace("?", "a"))
                want[key] = want.get(key, 0.0) + p / values
                share += p
    got = {r.key: r.mass for r in masses.collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and share == pytest.approx(1)
    r = entropy.email_entropy(masses, entropy.weights(domains, "name", "w")).first()
    assert r["total"] == 1.0 and r["p_max"] == pytest.approx(max(want.values()) * 0.75) and r["support"] == 2 * len(want) and want[r["modal"]] == pytest.approx(max(want.values()))
    assert r["h_inf_bits"] == pytest.approx(-math.log2(max(want.values()) * 0.75)) and r["h_inf_bits"] < r["h_max_bits"]
    for bad in ("{first}{first}", "##", "{middle}.{last}"):
        with pytest.raises(GateError):
            entropy.local_masses(entropy.weights(f, "name", "w"), entropy.weights(el, "name", "w"), (bad,))


def test_exact_bits_and_budgets(spark):
    r = entropy.ssn_entropy(spark).first()
    assert r["p_max"] == pytest.approx(2 / 899 / 99 / 9999) and r["support"] == 898 * 99 * 9999 and r["h_inf_bits"] == pytest.approx(28.7291, abs=1e-4)
    one = spark.range(1).select(entropy.needed_bits(F.lit(1000), 0.01).alias("need"), entropy.most_prompts(F.lit(20.0), 0.01, 2).alias("most"), entropy.most_fluency(F.lit(30.0), 0.01).alias("eta"), bounds.query_bound(F.lit(100), 10, 0.5, F.lit(20.0)).alias("q"))
    got = one.first()
    assert got["need"] == pytest.approx(math.log2(1000 / 0.01)) and got["most"] == pytest.approx(0.01 * 2**20 / 2) and got["eta"] == pytest.approx(30 - math.log2(100))
    assert got["q"] == pytest.approx(100 / (1 - 0.5**0.1) * 2.0**-20)


def test_digit_runs_of_a_vocabulary(spark):
    tokens = spark.createDataFrame([("v", t) for t in (" 123", "00000000", "12a", "", "7", " 12345 ", "x")] + [("w", "word")], "vocabulary string, text string")
    got = {r.vocabulary: r for r in entropy.digit_runs(tokens, "vocabulary").collect()}
    assert (got["v"].digit_tokens, got["v"].most_digits, got["v"].long_tokens, got["v"].longest) == (4, 8, 2, ["00000000", "12345"])
    assert (got["w"].digit_tokens, got["w"].most_digits, got["w"].longest) == (0, 1, [])
    assert [r[0] for r in spark.createDataFrame([(8, 48), (1, 3)], "d int, n int").select(entropy.multiplicity(F.col("d"), F.col("n"))).collect()] == [8 * 48 - 8, 1]


def test_vocabulary_as_a_table(spark):
    P = pytest.importorskip("public_tokenizers")
    from tallyglass.sources.vocabularies import read_vocabulary

    rows = read_vocabulary(spark, P.path("byte_bpe_50k.json"))
    got = {r.token: r.text for r in rows.where("token IN ('Ġthe', 'a', 'Ċ', 'Ã©')").collect()}
    assert got == {"Ġthe": " the", "a": "a", "Ċ": "\n", "Ã©": "é"} and rows.count() == 50256
    word = {r.token: r.text for r in read_vocabulary(spark, P.path("word_bpe_49k.json")).where("token IN ('the</w>', 'th')").collect()}
    assert word == {"the</w>": "the ", "th": "th"}

