"""Optimisers as coroutines: each yields coefficients and is sent the objective there.

So one fit can be driven by evaluations on arrays, and many fits in step with each other by one
Spark aggregate a round (:func:`together`).  All maximise within bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Hashable, Mapping
from dataclasses import dataclass

import numpy as np


@dataclass
class Point:
    """The objective at coefficients: value with penalties, log-likelihood without, gradient, Hessian."""

    value: float
    ll: float
    g: np.ndarray
    h: np.ndarray


@dataclass
class Optimum:
    theta: np.ndarray
    at: Point
    converged: bool
    iterations: int
    trace: list[tuple[int, float, float]]
    strategy: str = "newton"

    @property
    def value(self) -> float:
        return self.at.value


Steps = Generator[np.ndarray, Point, Optimum]


def newton_steps(start, lower, upper, tol: float = 1e-8, most: int = 100, watch: Callable[[int, float, float], None] | None = None) -> Steps:
    """Active coordinates stay, the Hessian's eigenvalues are made negative, steps are halved.

    ``watch`` is called with iteration, value and gradient size, and may raise to stop the fit.
    """
    theta = np.clip(np.asarray(start, float), lower, upper)
    at = yield theta
    trace: list[tuple[int, float, float]] = []
    converged, it = False, 0
    for it in range(1, most + 1):
        free = ~(((theta <= lower) & (at.g < 0)) | ((theta >= upper) & (at.g > 0)))
        size = float(np.abs(at.g[free]).max()) if free.any() else 0.0
        trace.append((it, at.value, size))
        if watch:
            watch(it, at.value, size)
        if size <= tol * max(1.0, abs(at.value)):
            converged = True
            break
        w, v = np.linalg.eigh(-at.h[np.ix_(free, free)])
        move = np.zeros_like(theta)
        move[free] = v @ ((v.T @ at.g[free]) / np.maximum(np.abs(w), 1e-6 * max(1.0, np.abs(w).max())))
        scale = 1.0
        for _ in range(40):
            new = np.clip(theta + scale * move, lower, upper)
            found = yield new
            if np.isfinite(found.value) and found.value > at.value - 1e-12 * abs(at.value):
                break
            scale /= 2
        stuck = np.abs(new - theta).max() < 1e-12 or (abs(found.value - at.value) <= 1e-13 * abs(at.value) and it > 3)
        theta, at = new, found
        if stuck:
            converged = size <= 1e-4 * max(1.0, abs(at.value))
            break
    # where the objective flattens out towards a bound, the bound itself is the maximum
    for i in np.flatnonzero((theta > lower) & (theta < upper)):
        edge = theta.copy()
        edge[i] = lower[i] if at.g[i] < 0 else upper[i]
        if abs(at.h[i, i]) <= 1e-3:
            found = yield edge
            if found.value >= at.value:
                theta, at = edge, found
    return Optimum(theta, at, converged, it, trace)


def adam_steps(start, lower, upper, rate: float = 0.05, most: int = 3000, tol: float = 1e-7, patience: int = 200, watch=None) -> Steps:
    """Adam with a falling rate, clipped gradients, projection on the bounds, and the rate halved on plateaus."""
    theta = np.clip(np.asarray(start, float), lower, upper)
    m = v = np.zeros_like(theta)
    trace: list[tuple[int, float, float]] = []
    best, since = -math.inf, 0
    at = yield theta
    for it in range(1, most + 1):
        g = np.clip(at.g / max(1.0, abs(at.value)), -10.0, 10.0)
        trace.append((it, at.value, float(np.abs(g).max())))
        if watch:
            watch(*trace[-1])
        if np.abs(g).max() < tol:
            return Optimum(theta, at, True, it, trace, "adam")
        best, since = (at.value, 0) if at.value > best + 1e-10 * abs(at.value) else (best, since + 1)
        if since >= patience:
            rate, since = rate / 2, 0
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate / math.sqrt(it / 100 + 1) * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-10)
        theta = np.clip(theta + move, lower, upper)
        at = yield theta
    return Optimum(theta, at, False, most, trace, "adam")


def multi_start_steps(start, lower, upper, starts: int = 5, seed: int = 42, watch=None) -> Steps:
    """The best of fits from ``start`` and seeded points within the bounds."""
    rng = np.random.default_rng(seed)
    spread = np.minimum(1.5, (upper - lower) / 6)
    points = [np.asarray(start, float)] + [np.clip(np.asarray(start) + rng.normal(0, spread), lower, upper) for _ in range(starts - 1)]
    best = None
    for x in points:
        found = yield from newton_steps(x, lower, upper, watch=watch)
        if best is None or (found.converged, found.value) > (best.converged, best.value):
            best = found
    best.strategy = "multi_start"
    return best


def hybrid_steps(start, lower, upper, watch=None) -> Steps:
    first = yield from newton_steps(start, lower, upper, watch=watch)
    if first.converged:
        return first
    return (yield from multi_start_steps(start, lower, upper, watch=watch))


STRATEGIES: dict[str, Callable[..., Steps]] = {
    "newton": newton_steps, "lbfgs": newton_steps, "slsqp": newton_steps, "adam": adam_steps, "multi_start": multi_start_steps, "hybrid": hybrid_steps,
}


def strategy_named(name: str) -> Callable[..., Steps]:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def alone(steps: Steps, evaluate: Callable[[np.ndarray], Point]) -> Optimum:
    """One fit, an evaluation at a time."""
    theta = next(steps)
    while True:
        try:
            theta = steps.send(evaluate(theta))
        except StopIteration as end:
            return end.value


def together(fits: Mapping[Hashable, Steps], evaluate: Callable[[dict[Hashable, np.ndarray]], Mapping[Hashable, Point]]) -> dict[Hashable, Optimum]:
    """Many fits in step: ``evaluate`` gets the coefficients of all that aren't done, at once."""
    asked = {k: next(steps) for k, steps in fits.items()}
    done: dict[Hashable, Optimum] = {}
    while asked:
        found, asked_next = evaluate(asked), {}
        for k in asked:
            try:
                asked_next[k] = fits[k].send(found[k])
            except StopIteration as end:
                done[k] = end.value
        asked = asked_next
    return done
