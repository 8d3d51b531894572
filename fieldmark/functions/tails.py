"""Tail probabilities of the normal, t and chi-square distributions as columns.

Incomplete gamma and beta functions: series and continued fractions of a fixed number of terms, as folds
over a sequence, so they run beside other expressions and without Python.  Beyond ``LARGE`` degrees of freedom
the gamma function's tail comes from its uniform expansion (error under 1e-8 there), t's from a normal one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS, LARGE = 400, 8000.0
TINY = 1e-300

# fixed values: Lanczos coefficients for g = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of x >= 0.5."""
    z = x - 1.0
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + float(k))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(b0: Column, term) -> Column:
    """b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method; ``term(k)`` gives (a_k, b_k) for a column k."""
    f0 = _safe(b0)
    start = F.struct(f0.alias("f"), f0.alias("c"), F.lit(0.0).alias("d"))

    def step(s, k):
        a, b = term(k.cast("double"))
        d = 1.0 / _safe(b + a * s["d"])
        c = _safe(b + a / s["c"])
        return F.struct((s["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["f"]


def _series(a: Column, x: Column) -> Column:
    """Sum over k of x^k / (a (a+1) ... (a+k))."""
    first = 1.0 / a
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(s, k):
        t = s["t"] * x / (a + k.cast("double"))
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["s"]


def _gamma_q_small(a: Column, x: Column) -> Column:
    scale = F.exp(a * F.ln(F.greatest(x, F.lit(TINY))) - x - log_gamma(a))
    below = 1.0 - scale * _series(a, x)
    above = scale / _fraction(x + 1.0 - a, lambda k: (-k * (k - a), x + 2.0 * k + 1.0 - a))
    return F.when(x <= 0, 1.0).when(x < a + 1, below).otherwise(above)


def erfc(z: Column) -> Column:
    q = _gamma_q_small(F.lit(0.5), z * z)
    return F.when(z >= 0, q).otherwise(2.0 - q)


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal distribution."""
    return 0.5 * erfc(z / math.sqrt(2.0))


def gamma_q(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function."""
    mu = x / a - 1.0
    eta = F.signum(mu) * F.sqrt(F.greatest(2.0 * (mu - F.log1p(F.greatest(mu, F.lit(-1 + 1e-15)))), F.lit(0.0)))
    # near the centre the difference of two poles, by its expansion
    flat = -1.0 / 3.0 + eta / 12.0 - eta * eta * 2.0 / 135.0
    poles = F.when(F.abs(mu) < 1e-3, flat).otherwise(1.0 / mu - 1.0 / eta)
    wide = 0.5 * erfc(eta * F.sqrt(a / 2.0)) + F.exp(-0.5 * a * eta * eta) / F.sqrt(2.0 * math.pi * a) * poles
    return F.when(x <= 0, 1.0).when(a <= LARGE / 2, _gamma_q_small(a, x)).otherwise(wide)


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square; null for nulls."""
    x, df = x.cast("double"), df.cast("double")
    return F.when(x.isNull() | df.isNull() | F.isnan(x), F.lit(None)).otherwise(F.least(F.greatest(gamma_q(df / 2.0, x / 2.0), F.lit(0.0)), F.lit(1.0)))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for x below (a + 1) / (a + b + 2)."""
    x = F.greatest(x, F.lit(TINY))
    scale = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x)) / a

    def term(k):
        m = F.floor(k / 2.0)
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        return F.when(k % 2 == 1, odd).otherwise(even), F.lit(1.0)

    return scale / _fraction(F.lit(1.0), term)


def t_sf(t: Column, df: Column) -> Column:
    """Upper tail of Student's t; null for nulls."""
    t, df = t.cast("double"), df.cast("double")
    a, half = df / 2.0, F.lit(0.5)
    x = df / (df + t * t)
    inner = F.when(x >= 1, 1.0).when(x <= (a + 1.0) / (a + 2.5), _beta_fraction(a, half, x)).otherwise(1.0 - _beta_fraction(half, a, 1.0 - x))
    near = 0.5 * inner
    # beyond LARGE: t made normal, error of order df^-2
    z = F.signum(t) * F.sqrt(df * F.log1p(t * t / df)) * (1.0 - 1.0 / (4.0 * df))
    tail = F.when(t >= 0, near).otherwise(1.0 - near)
    return F.when(t.isNull() | df.isNull() | F.isnan(t), F.lit(None)).when(df > LARGE, normal_sf(z)).otherwise(tail)
