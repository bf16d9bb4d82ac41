"""Tail probabilities and quantiles on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for a chi-squared variable: the regularised upper incomplete gamma function."""
    if x <= 0 or df <= 0:
        return 1.0
    a, x = df / 2, x / 2
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300  # continued fraction of the upper function
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * h
