"""Link functions and the temporal-symmetry likelihood as Column expressions.

An individual's history enters only through (x, e, l): captures, first and last occasion (from 0).
Every expression stays inside whole-stage code generation; logarithms are guarded by ``EPS``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def logit(p) -> Column:
    return F.ln(col(p) / (1.0 - col(p)))


def inv_logit(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def safe_ln(x) -> Column:
    return F.ln(F.greatest(col(x), F.lit(EPS)))


def seniority(phi, f) -> Column:
    """Probability that a member was one before: survival over growth."""
    return col(phi) / (col(phi) + col(f))


def growth(phi, f) -> Column:
    return col(phi) + col(f)


def unseen_tail(rate, p, n) -> Column:
    """Probability of no detection over ``n`` further steps with per-step rate and detection ``p``.

    The recursion q(n) = (1 - rate) + rate (1 - p) q(n - 1), q(0) = 1, is affine; this is its closed form.
    """
    rate, p, n = col(rate), col(p), col(n)
    b = rate * (1.0 - p)
    fixed = (1.0 - rate) / F.greatest(1.0 - b, F.lit(EPS))
    return fixed + F.power(b, n) * (1.0 - fixed)


def log_likelihood(phi, p, f, occasions: int, x="x", e="e", l="l") -> Column:  # noqa: E741
    """Log-likelihood of a history; 0 where nothing was captured."""
    phi, p, f = col(phi), col(p), col(f)
    gamma, span = seniority(phi, f), col(l) - col(e)
    seen = (col(x) - 1) * safe_ln(p) + (span - (col(x) - 1)) * safe_ln(1.0 - p)
    before, after = unseen_tail(gamma, p, e), unseen_tail(phi, p, F.lit(occasions - 1) - col(l))
    value = span * (safe_ln(phi) + safe_ln(gamma)) + 2.0 * seen + safe_ln(before) + safe_ln(after)
    return F.when(col(x) > 0, value).otherwise(F.lit(0.0))


def linear(terms: list[tuple[str, Column]], theta: list[float]) -> Column:
    """Sum of design columns times coefficients."""
    return reduce(lambda a, b: a + b, [c * F.lit(float(v)) for (_, c), v in zip(terms, theta, strict=True)])


def capture_curve(phi, p, occasions: int) -> Column:
    """Array of p * phi**t for t = 0..T-1."""
    return F.transform(F.sequence(F.lit(0), F.lit(occasions - 1)), lambda t: col(p) * F.power(col(phi), t.cast("double")))


def log_beta_prior(q, alpha: float = 2.0, beta: float = 2.0) -> Column:
    """Log of a beta density without its constant, argument kept off 0 and 1 by 1e-6."""
    q = F.least(F.greatest(col(q), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return (alpha - 1.0) * F.ln(q) + (beta - 1.0) * F.ln(1.0 - q)


def log_normal_prior(f, mode: float = 0.05, sigma: float = 0.75) -> Column:
    """Log of a log-normal density in f, by its mode and sigma."""
    f = F.greatest(col(f), F.lit(1e-12))
    mu = F.ln(F.lit(mode)) + sigma * sigma
    return -F.ln(f) - F.power(F.ln(f) - mu, F.lit(2.0)) / (2.0 * sigma * sigma) - F.lit(math.log(sigma) + 0.5 * math.log(2.0 * math.pi))


def barrier(q, jeffreys: bool = False) -> Column:
    """Log of q(1 - q), halved for ``jeffreys``."""
    q = col(q)
    return (F.ln(q + EPS) + F.ln(1.0 - q + EPS)) * (0.5 if jeffreys else 1.0)
