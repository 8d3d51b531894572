"""Normal, t and chi-square distribution functions without external libraries.

Incomplete gamma and beta functions by series and continued fractions; quantiles by bisection.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def normal_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def _fraction(b0: float, term) -> float:
    """b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method; ``term(k)`` gives (a_k, b_k)."""
    f = b0 or _TINY
    c, d = f, 0.0
    for k in range(1, 1000):
        a, b = term(k)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return f


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * scale
    return 1.0 - scale / _fraction(x + 1 - a, lambda k: (-k * (k - a), x + 2 * k + 1 - a))


def chi2_sf(x: float, df: float) -> float:
    return 1.0 - gamma_p(df / 2.0, x / 2.0)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1.0 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def term(k: int) -> tuple[float, float]:
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return scale / _fraction(1.0, term)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_i(df / 2.0, 0.5, df / (df + t * t))
    return 1.0 - tail if t > 0 else tail


def t_quantile(q: float, df: float) -> float:
    if q == 0.5:
        return 0.0
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > q:
        lo *= 2
    while t_cdf(hi, df) < q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < q else (lo, mid)
    return (lo + hi) / 2
