"""Distribution functions that the box has no library for."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    result = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            result *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * result


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_upper_1(x: float) -> float:
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def binomial_two_sided_half(k: int, n: int) -> float:
    """Exact test of probability one half."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(low + 1))
    return min(1.0, 2 * tail)


def mcnemar(b: int, c: int, exact_below: int = 25) -> tuple[float, float]:
    """Statistic and p: exact for few discordant pairs, else chi-square with continuity correction."""
    if b + c < exact_below:
        return float(min(b, c)), binomial_two_sided_half(b, b + c)
    x = (abs(b - c) - 1) ** 2 / (b + c)
    return x, chi2_upper_1(x)
