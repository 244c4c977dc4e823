"""Quantiles and bounds that stopping rules need, on the driver."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def _expanded(z: float, df: int) -> float:
    """The quantile's expansion in 1 / df (Fisher and Cornish), good to ten digits from 200 degrees of freedom on."""
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return z + g1 / df + g2 / df**2 + g3 / df**3 + g4 / df**4


@lru_cache(100_000)
def student_quantile(p: float, df: int) -> float:
    """The value that a Student t variable stays below with probability p > 0.5; normal beyond 100,000 degrees of freedom."""
    if df > 100_000:
        return normal_quantile(p)
    if df > 200:
        return _expanded(normal_quantile(p), df)
    upper = 2 * (1 - p)
    low, high = 0.0, 1.0
    while beta_cdf(df / 2, 0.5, df / (df + high * high)) > upper:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        if beta_cdf(df / 2, 0.5, df / (df + mid * mid)) > upper:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def chernoff_bound(eps: float, alpha: float) -> float:
    return (eps + 2) * math.log(2 / alpha) / eps**2


def clt_bound(eps: float, alpha: float) -> int:
    return math.ceil(normal_quantile(1 - alpha / 2) ** 2 * 0.25 / eps**2)


def stop_at(bound: float, total: int, min_samples: int) -> int:
    """The first draw at which a rule with a fixed bound stops: never below the minimum, never above the total."""
    return min(total, max(min(min_samples, total), math.ceil(bound)))
