"""Interval-censored threshold fits that say when they fail.

log T = intercept + slope * log h + scale * error, T in (low, high]; low may be 0 and high infinite. The error is the
least extreme value's (``weibull``) or normal (``lognormal``). A fit without an optimum inside ``BOUNDS``, with a
gradient that doesn't vanish, or with a direction that the data don't determine raises ``FitError``.

Refits of drawn persons share the draws of ``operators.draws``. Equal targets are one cell of (h, low, high), so a
replicate is a row of weights; a chunk of replicates is fitted at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.optimise import curvature, minimise, well_determined
from tallyglass.operators import draws

#: Of the mean log threshold at the mean log h, beyond the observed ones; of the slope; of the log scale.
BOUNDS = (20.0, 40.0, 5.0)

_erfc = np.frompyfunc(math.erfc, 1, 1)


class FitError(ValueError):
    """No optimum that can be trusted."""


def _log_upper_normal(z: np.ndarray) -> np.ndarray:
    """log P(Z > z), z >= 0 or infinite."""
    near = z < 30
    with np.errstate(divide="ignore"):
        head = np.log(0.5 * _erfc(np.where(near, z, 0.0) / math.sqrt(2)).astype(float))
    far = np.where(near, 1.0, np.where(np.isfinite(z), z, 1.0))
    tail = -0.5 * far * far - np.log(far * math.sqrt(2 * math.pi)) + np.log1p(-1 / (far * far) + 3 / far**4)
    return np.where(near, head, np.where(np.isfinite(z), tail, -np.inf))


def _normal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P(a < Z <= b) and its derivatives by a and b."""
    flip = a + b < 0
    near, far = np.where(flip, -b, a), np.where(flip, -a, b)  # the interval, mirrored to the side where it lies right of 0 or around it
    low = np.where(near >= 0, _log_upper_normal(np.maximum(near, 0.0)), np.log1p(-np.exp(_log_upper_normal(np.maximum(-near, 0.0)))))
    high = _log_upper_normal(np.maximum(far, 0.0))
    log_p = low + np.log(-np.expm1(np.minimum(high - low, -1e-15)))
    density = lambda z: np.where(np.isfinite(z), np.exp(np.minimum(-0.5 * np.where(np.isfinite(z), z, 0.0) ** 2 - 0.5 * math.log(2 * math.pi) - log_p, 700.0)), 0.0)
    return log_p, -density(a), density(b)


def _extreme(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(S(a) - S(b)) of S(z) = exp(-exp(z)) and its derivatives by a and b."""
    begin = np.exp(np.minimum(a, 60.0))
    finite = np.isfinite(b)
    gap = np.where(finite, np.maximum(np.exp(np.minimum(np.where(finite, b, 0.0), 60.0)) - begin, 1e-300), np.inf)
    share = -np.expm1(-gap)
    end = np.where(finite, begin + np.where(finite, gap, 0.0), 0.0)
    return -begin + np.log(share), -begin / share, end * np.exp(-np.where(finite, gap, 0.0)) / share * finite


FAMILIES = {"weibull": _extreme, "lognormal": _normal}


class _Likelihood:
    """The negative log likelihood of weighted cells, for many rows of weights; log h is measured from ``centre``."""

    def __init__(self, h, low, high, weights: np.ndarray, family: str, centre: float):
        self.x = np.log(h) - centre
        with np.errstate(divide="ignore"):
            self.low, self.high = np.log(low), np.log(high)
        self.weights, self.error = weights, FAMILIES[family]

    def __call__(self, points: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            return self._parts(points, self.weights[which])

    def _parts(self, points, w):
        scale = np.exp(points[:, 2:3])
        mean = points[:, :1] + points[:, 1:2] * self.x
        a, b = (self.low - mean) / scale, (self.high - mean) / scale
        value, by_a, by_b = self.error(a, b)
        by_mean = -(by_a + by_b) / scale
        by_scale = -(by_a * np.where(np.isfinite(a), a, 0.0) + by_b * np.where(np.isfinite(b), b, 0.0))
        used = w > 0
        total = lambda v: np.where(used, w * np.where(used, v, 0.0), 0.0).sum(axis=1)
        return -total(value), -np.stack([total(by_mean), total(by_mean * self.x), total(by_scale)], axis=1)


def _first_guess(f: _Likelihood, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Weighted mean of the intervals' log middles, slope 1, scale 1/2."""
    finite = np.isfinite(high)
    middle = np.log(np.where(finite, np.sqrt(np.maximum(low, 0.5) * np.where(finite, high, 1.0)), np.maximum(low, 0.5)))
    mean = (f.weights * middle).sum(axis=1) / f.weights.sum(axis=1)
    return np.stack([mean, np.ones_like(mean), np.full_like(mean, -0.7)], axis=1)


def fit_many(h: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray, family: str = "weibull", start: np.ndarray | None = None, centre: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercept, slope, log scale) of every row of weights, its log likelihood, and whether the second start was needed.

    Fits go from ``start`` (intercept at log h = 0), and those that fail once more from each row's own first guess. Raises if any fails twice.
    """
    h, low, high, weights = (np.asarray(v, float) for v in (h, low, high, weights))
    if not len(h) or (h <= 0).any() or (low < 0).any() or (high <= low).any() or not np.isfinite(low).all() or (weights.sum(axis=1) <= 0).any():
        raise FitError("targets need h > 0 and 0 <= low < high, and replicates a weight")
    centre = float(np.log(h).mean()) if centre is None else centre
    edges = np.concatenate((np.log(np.maximum(low, 0.5)), np.log(high[np.isfinite(high)])))
    most = np.array([0.0, BOUNDS[1], BOUNDS[2]])
    lowest, highest = -most, most.copy()
    lowest[0], highest[0] = edges.min() - BOUNDS[0], edges.max() + BOUNDS[0]

    def attempt(rows: np.ndarray, first: np.ndarray):
        f = _Likelihood(h, low, high, weights[rows], family, centre)
        x, value, solved = minimise(f, _first_guess(f, low, high) if first is None else first, lowest, highest)
        inside = ((x > lowest) & (x < highest)).all(axis=1)
        certain = value <= 1e-6 * f.weights.sum(axis=1)  # every target is certain, so smaller scales do as well
        return x, value, solved & inside & ~certain & well_determined(curvature(f, x))

    every = np.arange(len(weights))
    given = None if start is None else np.tile(np.array([start[0] + start[1] * centre, start[1], start[2]]), (len(every), 1))
    x, value, good = attempt(every, given)
    again = ~good
    if given is not None and again.any():
        x[again], value[again], good[again] = attempt(every[again], None)
    if not good.all():
        bad = int(np.flatnonzero(~good)[0])
        raise FitError(f"{family} fit: {int((~good).sum())} of {len(good)} have no determined optimum within bounds; number {bad} stopped at {x[bad].tolist()}")
    x[:, 0] -= x[:, 1] * centre
    return x, -value, again


def fit(h: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray | None = None, family: str = "weibull", start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(intercept, slope, log scale) and the log likelihood of weighted targets."""
    theta, value, _ = fit_many(h, low, high, np.ones((1, len(h))) if w is None else np.asarray(w, float)[None], family, start)
    return theta[0], float(value[0])


def log_likelihood(theta: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray, family: str = "weibull") -> float:
    return -float(_Likelihood(h, low, high, np.asarray(w, float)[None], family, 0.0)(np.asarray(theta, float)[None], np.zeros(1, int))[0][0])


def cells_of(targets: DataFrame, person: str = "person_id", arm: str = "target_membership") -> DataFrame:
    """arm, person, h, low, high and n, how many targets; all of one arm without a name where there is none."""
    held = targets if arm in targets.columns else targets.withColumn(arm, F.lit(""))
    return held.groupBy(arm, person, "h", "low", "high").agg(F.count("*").alias("n"))


def point_fit(cells: DataFrame, family: str = "weibull") -> tuple[np.ndarray, float, int]:
    """Parameters, log likelihood and number of targets; distinct (h, low, high) reach the driver, not targets."""
    held = cells.groupBy("h", "low", "high").agg(F.sum("n").alias("w")).orderBy("h", "low", "high").toPandas()
    if held.empty:
        raise FitError("no targets")
    theta, value = fit(*(held[c].to_numpy(float) for c in ("h", "low", "high", "w")), family)
    return theta, value, int(held["w"].sum())


def slope_replicates(cells: DataFrame, reps: int, family: str, start: np.ndarray, at: DataFrame | None = None, seed: int = draws.SEED, person: str = "person_id", arm: str = "target_membership") -> DataFrame:
    """rep, intercept, slope, log_scale, second_start of refits with persons drawn again.

    ``at``: draws.places() of the persons that are drawn from, so that the fit shares the draws of other analyses. A replicate is fitted in
    one task with a chunk of others, on its cells.
    """
    at = draws.places(cells, arm, person) if at is None else at
    parts = draws.drawn_sums(cells, at, ["h", "low", "high"], ["n"], reps, seed, arm, person)
    centre = float(cells.select("h").distinct().agg(F.avg(F.log("h"))).first()[0])
    start = [float(v) for v in start]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "low", "high"])
        weights = np.stack(rows["n"].to_numpy()).T
        theta, _, again = fit_many(*(rows[c].to_numpy(float) for c in ("h", "low", "high")), weights, family, np.array(start), centre)
        first = int(rows["chunk"].iloc[0]) * draws.CHUNK
        return pd.DataFrame({"rep": np.arange(first, first + len(theta), dtype=np.int32), "intercept": theta[:, 0], "slope": theta[:, 1], "log_scale": theta[:, 2], "second_start": again})

    return parts.groupBy(arm, "chunk").applyInPandas(run, "rep int, intercept double, slope double, log_scale double, second_start boolean")


def slope_interval(targets: DataFrame, reps: int, family: str = "weibull", person: str = "person_id", null: float = 1.0, seed: int = draws.SEED, at: DataFrame | None = None) -> DataFrame:
    """One row: targets, replicates, the point fit, the slope's 95 % interval and its two-sided centred bootstrap p against ``null``, and how many refits took the second start."""
    cells = cells_of(targets, person)
    (intercept, slope, log_scale), value, n = point_fit(cells, family)
    found = slope_replicates(cells, reps, family, np.array([intercept, slope, log_scale]), at, seed, person)
    far = F.abs(F.col("slope") - float(slope)) >= abs(float(slope) - null) - 1e-12
    q = lambda p: F.percentile("slope", F.lit(p))
    ends = found.agg(F.count("slope").alias("reps"), q(0.025).alias("lo"), q(0.975).alias("hi"), ((F.count_if(far) + 1) / (F.count("slope") + 1)).alias("p"), F.count_if("second_start").alias("second_starts"))
    point = [F.lit(float(v)).alias(k) for k, v in (("intercept", intercept), ("slope", slope), ("log_scale", log_scale), ("log_likelihood", value))]
    return ends.select(F.lit(n).alias("n"), "reps", *point, "lo", "hi", "p", "second_starts")


def censor_summary(kmins: DataFrame) -> DataFrame:
    return kmins.groupBy("target_membership").agg(F.count("*").alias("n"), F.count_if(F.col("right_censored")).alias("n_censored"), F.count_if(F.col("nonmonotone")).alias("n_nonmonotone"), F.expr("percentile(upper_k, 0.5)").alias("median_k"))
