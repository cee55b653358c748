"""Small statistics helpers for single values."""

from __future__ import annotations

import math


def regularised_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - regularised_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    result = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            result *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * result


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return regularised_beta(df / (df + t * t), df / 2, 0.5)


def slope_p_value(r2: float | None, n: int) -> float | None:
    """Two-sided p-value of a regression slope from R2 and the number of points."""
    if r2 is None:
        return None
    if n == 2:
        return 1.0 if r2 == 0 else 0.0
    if r2 >= 1:
        return 0.0
    return t_p_value(math.sqrt(r2 * (n - 2) / (1 - r2)), n - 2)
