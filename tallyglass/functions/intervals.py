"""Confidence intervals of rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions import special

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def wilson(rate: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound; n may be an effective, fractional size."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    centre = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def mover(p: Column, p_bounds: tuple[Column, Column], q: Column, q_bounds: tuple[Column, Column]) -> tuple[Column, Column]:
    """Bounds of p - q from the bounds of each."""
    gap = p - q
    return gap - F.hypot(p - p_bounds[0], q_bounds[1] - q), gap + F.hypot(p_bounds[1] - p, q - q_bounds[0])


def clopper_pearson(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact bounds by the inverse incomplete beta function."""
    if n == 0:
        return float("nan"), float("nan")
    tail = (1 - level) / 2
    low = 0.0 if hits == 0 else special.beta_quantile(tail, hits, n - hits + 1)
    high = 1.0 if hits == n else special.beta_quantile(1 - tail, hits + 1, n - hits)
    return low, high
