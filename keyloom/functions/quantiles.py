"""Normal and Student t quantiles in plain Python."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _t_tail(t: float, df: int) -> float:
    """P(|T| > t), by the finite trigonometric sums for integer degrees of freedom."""
    theta = math.atan(t / math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df % 2:
        total, term = 0.0, c
        for k in range(3, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        inside = 2 / math.pi * (theta + s * total) if df > 1 else 2 * theta / math.pi
    else:
        total, term = 0.0, 1.0
        for k in range(2, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        inside = s * total
    return 1.0 - inside


@lru_cache(maxsize=4096)
def student_t_quantile(p: float, df: int) -> float:
    """Value t with P(T <= t) = p for p >= 0.5, found by bisection."""
    if df < 1:
        return math.nan
    if p >= 1.0:
        return math.inf
    low, high = 0.0, 1.0
    tail = 2 * (1 - p)
    while _t_tail(high, df) > tail:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if _t_tail(middle, df) > tail else (low, middle)
    return (low + high) / 2


def confidence_factor(confidence: float, count: int) -> float:
    """Half-width of the interval in standard errors: normal above 100 values, else t."""
    p = 1 - (1 - confidence) / 2
    return normal_quantile(p) if count > 100 else student_t_quantile(p, count - 1)
