"""Models of grouped capture rows: values by row, penalties, and their sums with derivatives.

The temporal-symmetry model has survival, detection and recruitment; others are registered with
parameters of their own.  Priors and penalties go into the objective, and never into the log-likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd

from fieldmark.functions.dual import at_least, between, exp, log, sigmoid, variables, where
from fieldmark.operators.optimise import Point

PARAMETERS = ("phi", "p", "f")
EPS = 1e-12
LIMIT = math.log(0.999 / 0.001)
BOUNDS = {"phi": (-LIMIT, LIMIT), "p": (-LIMIT, LIMIT), "f": (math.log(1e-8), math.log(10.0))}


@dataclass(frozen=True)
class Problem:
    """Grouped rows as arrays: x, e, l, counts n, a design matrix for each parameter."""

    x: np.ndarray
    e: np.ndarray
    l: np.ndarray  # noqa: E741
    n: np.ndarray
    designs: tuple[np.ndarray, ...]
    occasions: int

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([0, *[d.shape[1] for d in self.designs]]).tolist()


def _tail(r, p, n):
    """Probability of no detection over n steps."""
    b = r * (1 - p)
    s = (1 - r) / at_least(1 - b, EPS)
    return s + b**n * (1 - s)


@dataclass(frozen=True)
class Penalty:
    """What is added to the objective: ridge on coefficients, priors summed over individuals, a barrier averaged over them.

    ``ridge`` leaves intercepts out unless ``intercepts``; ``beta`` is the weight of a Beta(a, b) prior on phi
    and p, ``recruitment`` that of a log-normal prior (mode, sigma) on f; ``barrier`` weighs the mean of
    ln q(1-q) of phi and p, halved with ``jeffreys``.
    """

    ridge: float = 0.0
    intercepts: bool = False
    beta: float = 0.0
    shape: tuple[float, float] = (2.0, 2.0)
    recruitment: float = 0.0
    mode: float = 0.05
    sigma: float = 0.75
    barrier: float = 0.0
    jeffreys: bool = False

    def mask(self, names: Sequence[tuple[str, str]]) -> np.ndarray:
        return np.array([1.0 if self.intercepts or t != "(Intercept)" else 0.0 for _, t in names])


NO_PENALTY = Penalty()


def rows_of_model(etas: Sequence, q: Problem, penalty: Penalty = NO_PENALTY, total: float = 1.0) -> tuple:
    """Per row, from the three linear predictors: log-likelihood, and its value with priors."""
    phi, p, f = sigmoid(etas[0]), sigmoid(etas[1]), exp(etas[2])
    gamma, span, m = phi / (phi + f), q.l - q.e, (q.l - q.e) - (q.x - 1)
    ln = lambda v: log(at_least(v, EPS))
    ll = span * (ln(phi) + ln(gamma)) + 2 * ((q.x - 1) * ln(p) + m * ln(1 - p)) + ln(_tail(gamma, p, q.e)) + ln(_tail(phi, p, q.occasions - 1 - q.l))
    ll = where(q.x > 0, ll, 0.0)
    value = ll
    if penalty.beta:
        a, b = penalty.shape
        for v in (phi, p):
            v = between(v, 1e-6, 1 - 1e-6)
            value = value + penalty.beta * ((a - 1) * log(v) + (b - 1) * log(1 - v))
    if penalty.recruitment:
        z = (etas[2] - (math.log(penalty.mode) + penalty.sigma**2)) / penalty.sigma
        value = value + penalty.recruitment * (-0.5 * z * z - etas[2] - math.log(penalty.sigma) - 0.5 * math.log(2 * math.pi))
    if penalty.barrier:
        w = penalty.barrier * (0.5 if penalty.jeffreys else 1.0) / total
        for v in (phi, p):
            value = value + w * (log(v + EPS) + log(1 - v + EPS))
    return ll, value


@dataclass(frozen=True)
class Model:
    """A model: ``rows(etas, problem, penalty, total)`` gives each row's log-likelihood and value from linear predictors.

    ``rows`` is written with the functions of :mod:`fieldmark.functions.dual`, which bring derivatives along.  ``bounds``
    are those of linear predictors; ``growth(etas)`` is each row's growth rate, where the model has one.
    """

    name: str
    rows: Callable[..., tuple]
    bounds: Mapping[str, tuple[float, float]]
    parameters: tuple[str, ...] = PARAMETERS
    growth: Callable[[Sequence[np.ndarray]], np.ndarray] | None = None


MODELS: dict[str, Model] = {}


def register_model(model: Model) -> None:
    MODELS[model.name] = model


def get_model(name: str) -> Model:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {sorted(MODELS)}")
    return MODELS[name]


register_model(Model("temporal_symmetry", rows_of_model, BOUNDS, growth=lambda etas: sigmoid(etas[0]) + np.exp(etas[2])))


def predictors(theta: np.ndarray, q: Problem) -> list[np.ndarray]:
    c = q.cuts
    return [d @ theta[c[i] : c[i + 1]] for i, d in enumerate(q.designs)]


def sums(theta: np.ndarray, q: Problem, penalty: Penalty = NO_PENALTY, total: float = 1.0, rows=rows_of_model) -> np.ndarray:
    """Sums over rows, end to end: log-likelihood, value, gradient and Hessian in the coefficients."""
    c, m = q.cuts, len(q.designs)
    ll, value = rows(variables(predictors(theta, q)), q, penalty, total)
    h = np.empty((c[m], c[m]))
    for i in range(m):
        for j in range(m):
            h[c[i] : c[i + 1], c[j] : c[j + 1]] = (q.designs[i] * (q.n * value.h[i, j])[:, None]).T @ q.designs[j]
    g = np.concatenate([(q.n * value.g[i]) @ q.designs[i] for i in range(m)])
    return np.concatenate([[q.n @ ll.v, q.n @ value.v], g, ((h + h.T) / 2).ravel()])


def point(theta: np.ndarray, total: np.ndarray, penalty: Penalty, mask: np.ndarray) -> Point:
    """From sums over all rows; adds the ridge."""
    k = len(theta)
    r = penalty.ridge * mask
    return Point(float(total[1] - (r * theta**2).sum()), float(total[0]), total[2 : 2 + k] - 2 * r * theta, total[2 + k :].reshape(k, k) - 2 * np.diag(r))


def value_and_gradient(theta: np.ndarray, q: Problem) -> tuple[float, np.ndarray]:
    """Log-likelihood and its gradient over coefficients (phi, p, f)."""
    s = sums(np.asarray(theta, float), q)
    return float(s[0]), s[2 : 2 + len(theta)]


def problem(pdf: pd.DataFrame, columns: Sequence[Sequence[str]], occasions: int, n: np.ndarray | None = None) -> Problem:
    """Rows of a table as arrays; ``n`` stands in for its counts."""
    get = lambda c: pdf[c].to_numpy(float)
    designs = tuple(np.stack([get(c) for c in cols], axis=1) for cols in columns)
    return Problem(get("x"), get("e"), get("l"), get("n") if n is None else n, designs, occasions)


def bounds(names: Sequence[tuple[str, str]], model: Model) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([model.bounds[a][i] for a, _ in names]) for i in (0, 1))
