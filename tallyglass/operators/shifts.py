"""How many more free tokens controls need to reach the trained rate.

A capacity curve is ceiling * exp(-exp(-(log2 k - place) / width)). Both arms share width and ceiling and have a place
each; the shift is the distance of the capacities at which they reach half the ceiling. Whether the
arms may share a width is tested against a width for each (likelihood ratio, one degree of freedom).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.optimise import minimise
from tallyglass.operators import draws
from tallyglass.operators.rates import r9

CLIP = 1e-12
_HALF = math.log(math.log(2.0))
#: Bounds of a place, a log width and the ceiling.
_PLACE, _WIDTH, _TOP = (-10.0, 20.0), (-4.0, 4.0), (1e-3, 1.0)


class ShiftError(ValueError):
    """No start led to an optimum."""


def _arm(x, hits, n, place, log_width, top):
    """Negative log likelihood of binomial counts and its derivatives by place, log width and ceiling; a row for each problem."""
    width = np.exp(log_width)
    u = np.clip(-(x - place) / width, -700, 700)
    e = np.exp(u)
    p = np.clip(top * np.exp(-np.minimum(e, 700)), CLIP, 1 - CLIP)
    value = -(hits * np.log(p) + (n - hits) * np.log1p(-p)).sum(axis=1)
    by_p = (n - hits) / (1 - p) - hits / p
    inside = (p > CLIP) & (p < 1 - CLIP)
    by_p = np.where(inside, by_p, 0.0)
    total = lambda v: (by_p * v).sum(axis=1)
    return value, total(-p * e / width), total(p * e * u), total(p / top)


def fit_shift(k: np.ndarray, hits_c: np.ndarray, n_c: np.ndarray, hits_d: np.ndarray, n_d: np.ndarray, start: list[float] | None = None) -> dict[str, np.ndarray]:
    """Fits of many pairs of curves (rows) on the same capacities, all above 0: places, width, ceiling, medians, shift and likelihood ratio.

    ``start``: both places, log width and ceiling of a curve near them all; without it more starts are tried.
    """
    x = np.log2(np.asarray(k, float))
    hits_c, n_c, hits_d, n_d = (np.atleast_2d(np.asarray(v, float)) for v in (hits_c, n_c, hits_d, n_d))
    if not len(x) or (x < 0).any() or (n_c.sum(axis=1) <= 0).any() or (n_d.sum(axis=1) <= 0).any():
        raise ShiftError("both arms need attempts at capacities from 1 on")

    def shared(q, rows):
        c = _arm(x, hits_c[rows], n_c[rows], q[:, 0:1], q[:, 2:3], q[:, 3:4])
        d = _arm(x, hits_d[rows], n_d[rows], q[:, 1:2], q[:, 2:3], q[:, 3:4])
        return c[0] + d[0], np.stack([c[1], d[1], c[2] + d[2], c[3] + d[3]], axis=1)

    def free(q, rows):
        c = _arm(x, hits_c[rows], n_c[rows], q[:, 0:1], q[:, 2:3], q[:, 4:5])
        d = _arm(x, hits_d[rows], n_d[rows], q[:, 1:2], q[:, 3:4], q[:, 4:5])
        return c[0] + d[0], np.stack([c[1], d[1], c[2], d[2], c[3] + d[3]], axis=1)

    def best(f, starts, widths: int):
        low, high = (np.array([_PLACE[i], _PLACE[i], *[_WIDTH[i]] * widths, _TOP[i]]) for i in (0, 1))
        at, least = np.zeros((len(hits_c), len(low))), np.full(len(hits_c), np.inf)
        for start in starts:
            q, value, solved = minimise(f, start, low, high)
            better = solved & (value < least)
            at[better], least[better] = q[better], value[better]
        if not np.isfinite(least).all():
            raise ShiftError(f"{int((~np.isfinite(least)).sum())} of {len(least)} curves have no optimum")
        return at, least

    def places(hits, n):
        """Where the observed rate first passes half its maximum."""
        rate = hits / np.maximum(n, 1)
        return x[np.argmax(rate >= rate.max(axis=1, keepdims=True) / 2, axis=1)]

    first_c, first_d = places(hits_c, n_c), places(hits_d, n_d)
    top = np.clip(np.maximum((hits_c / np.maximum(n_c, 1)).max(axis=1), (hits_d / np.maximum(n_d, 1)).max(axis=1)), 0.05, 0.98)
    begin = lambda w, t: np.stack([first_c, first_d, np.full_like(first_c, w), np.clip(top * t, 0.02, 0.99)], axis=1)
    starts = [begin(w, t) for w in (-1.2, -0.35, 0.5) for t in (1.0, 0.8)] if start is None else [np.tile(start, (len(first_c), 1)), begin(-0.35, 1.0)]
    at, least = best(shared, starts, 1)
    # the free model begins where the shared one ends, so it can't be worse
    own = lambda a, b: np.stack([at[:, 0], at[:, 1], np.clip(at[:, 2] + a, *_WIDTH), np.clip(at[:, 2] + b, *_WIDTH), at[:, 3]], axis=1)
    free_at, free_least = best(free, [own(0, 0)] if start is not None else [own(0, 0), own(0.5, -0.5), own(-0.5, 0.5)], 2)
    ratio = np.maximum(0.0, 2 * (least - free_least))
    width = np.exp(at[:, 2])
    median = lambda place: 2 ** (place - width * _HALF)
    return {
        "place_control": at[:, 0], "place_trained": at[:, 1], "width": width, "ceiling": at[:, 3], "k50_control": median(at[:, 0]), "k50_trained": median(at[:, 1]),
        "shift_tokens": median(at[:, 0]) - median(at[:, 1]), "shift_factor": 2 ** (at[:, 0] - at[:, 1]), "nll_shared": least, "nll_free": free_least, "lr": ratio, "lr_p": np.array([math.erfc(math.sqrt(v / 2)) for v in ratio]),
        "width_control": np.exp(free_at[:, 2]), "width_trained": np.exp(free_at[:, 3]),
    }


def horizontal_shift(points: DataFrame) -> DataFrame:
    """One row of ``fit_shift`` on a curve with hits and n of both arms (a row for each capacity reaches the driver)."""
    rows = points.where("capacity_k > 0 AND n_c > 0 AND n_d > 0").orderBy("capacity_k").select("capacity_k", "hits_c", "n_c", "hits_d", "n_d").toPandas()
    found = fit_shift(*(rows[c].to_numpy(float) for c in rows.columns))
    return points.sparkSession.createDataFrame([tuple(float(v[0]) for v in found.values())], ", ".join(f"{k} double" for k in found))


def shift_replicates(att: DataFrame, reps: int, start: list[float] | None = None, at: DataFrame | None = None, seed: int = draws.SEED) -> DataFrame:
    """rep, shift_tokens, shift_factor, lr of each replicate of drawn persons; a chunk is fitted at once."""
    tried = att.where("capacity_k > 0")
    parts = draws.drawn_sums(draws.attempt_sums(tried, "capacity_k"), draws.places(att) if at is None else at, ["capacity_k"], ["h", "n"], reps, seed)
    names = ["shift_tokens", "shift_factor", "lr"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = int(rows["chunk"].iloc[0])
        grid = np.sort(rows["capacity_k"].unique())
        table = {(r.target_membership, r.capacity_k): (np.asarray(r.h), np.asarray(r.n)) for r in rows.itertuples()}
        size = len(rows["h"].iloc[0])
        side = lambda arm, i: np.stack([table.get((arm, k), (np.zeros(size),) * 2)[i] for k in grid], axis=1)
        found = fit_shift(grid, side("control", 0), side("control", 1), side("trained", 0), side("trained", 1), start)
        out = pd.DataFrame({n: found[n] for n in names})
        out.insert(0, "rep", np.arange(size, dtype=np.int32) + chunk * draws.CHUNK)
        return out

    return parts.groupBy("chunk").applyInPandas(run, f"rep int, {', '.join(f'{n} double' for n in names)}")


def shift_interval(att: DataFrame, points: DataFrame, reps: int, seed: int = draws.SEED) -> DataFrame:
    """The point fit with 95 % intervals of the shift in tokens and as a factor."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    point = horizontal_shift(points)
    at = point.first()
    ends = shift_replicates(att, reps, [at["place_control"], at["place_trained"], math.log(at["width"]), at["ceiling"]], seed=seed).agg(F.count("shift_tokens").alias("reps"), *[q(c, p).alias(f"{c}_{n}") for c in ("shift_tokens", "shift_factor") for n, p in (("lo", 0.025), ("hi", 0.975))])
    return point.crossJoin(F.broadcast(ends))  # a row each


def likelihood_grid(points: DataFrame, places: list[float], widths: list[float], ceilings: list[float]) -> DataFrame:
    """arm, place, width, ceiling, nll of every point of a grid of parameters, without leaving the JVM."""
    p = points.where("capacity_k > 0").select(F.log2(F.col("capacity_k").cast("double")).alias("x"), "hits_c", "n_c", "hits_d", "n_d")
    side = lambda a, name: p.groupBy(F.lit(name).alias("arm")).agg(F.array_sort(F.collect_list(F.struct("x", F.col(f"hits_{a}").cast("double").alias("h"), F.col(f"n_{a}").cast("double").alias("n")))).alias("curve"))
    arms = side("c", "control").unionByName(side("d", "trained"))  # a row each, of as many points as there are capacities
    listed = lambda values: F.explode(F.array(*[F.lit(float(v)) for v in values]))
    grid = arms.withColumn("place", listed(places)).withColumn("width", listed(widths)).withColumn("ceiling", listed(ceilings))

    def part(s: Column) -> Column:
        rate = F.col("ceiling") * F.exp(-F.exp(-(s.x - F.col("place")) / F.col("width")))
        rate = F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), rate))
        return -(s.h * F.log(rate) + (s.n - s.h) * F.log(1 - rate))

    return grid.select("arm", "place", "width", "ceiling", F.aggregate("curve", F.lit(0.0), lambda a, s: a + part(s)).alias("nll"))


def grid_fit(grid: DataFrame) -> DataFrame:
    """One row: the grid's best places, width and ceiling with a shared width, and how much two widths gain (lr); values that agree to 9 places are ties, which go to the smaller parameters."""
    least = lambda *order: F.min(F.struct(r9(F.col("nll")).alias("nll"), *order))
    arm = grid.groupBy("arm", "width", "ceiling").agg(least("place").alias("b"))
    side = lambda name: F.max(F.when(F.col("arm") == name, F.col("b")))
    both = arm.groupBy("width", "ceiling").agg(side("control").alias("c"), side("trained").alias("d"))
    shared = both.select(F.lit(1).alias("one"), r9(F.col("c.nll") + F.col("d.nll")).alias("nll"), "width", "ceiling", F.col("c.place").alias("place_control"), F.col("d.place").alias("place_trained"))
    free = both.groupBy("ceiling").agg((F.min("c.nll") + F.min("d.nll")).alias("nll"))  # widths apart, one ceiling
    order = ["nll", "width", "ceiling", "place_control", "place_trained"]
    best = shared.agg(F.min(F.struct(*order)).alias("b")).select("b.*")
    gain = free.agg(r9(F.min("nll")).alias("nll_free"))
    return best.crossJoin(F.broadcast(gain)).withColumn("lr", r9(2 * (F.col("nll") - F.col("nll_free"))))  # a row each
