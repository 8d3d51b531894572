"""Second-order forward arithmetic on arrays: a value with its gradient and Hessian in a few variables.

Likelihoods are written once, as values; derivatives come along.  The functions here take plain arrays as
well, and then return plain arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Dual:
    """``v`` of shape (n,), ``g`` of (m, n), ``h`` of (m, m, n)."""

    __array_ufunc__ = None  # arrays leave mixed operations to this class
    __slots__ = ("g", "h", "v")

    def __init__(self, v: np.ndarray, g: np.ndarray, h: np.ndarray):
        self.v, self.g, self.h = v, g, h

    def mapped(self, v: np.ndarray, first: np.ndarray, second: np.ndarray) -> Dual:
        """A function of this value from its value and two derivatives there."""
        return Dual(v, first * self.g, first * self.h + second * self.g[:, None] * self.g[None, :])

    def __add__(self, o) -> Dual:
        return Dual(self.v + o.v, self.g + o.g, self.h + o.h) if isinstance(o, Dual) else Dual(self.v + o, self.g, self.h)

    def __mul__(self, o) -> Dual:
        if not isinstance(o, Dual):
            return Dual(self.v * o, self.g * o, self.h * o)
        cross = self.g[:, None] * o.g[None, :]
        return Dual(self.v * o.v, self.g * o.v + o.g * self.v, self.h * o.v + o.h * self.v + cross + cross.swapaxes(0, 1))

    def __pow__(self, n) -> Dual:
        """Power by whole numbers of 0 or more (an array or a number)."""
        n = np.asarray(n, float)
        low = lambda k: np.where(n >= k, self.v ** np.maximum(n - k, 0), 0.0)
        return self.mapped(self.v**n, n * low(1), n * (n - 1) * low(2))

    def inverse(self) -> Dual:
        return self.mapped(1 / self.v, -1 / self.v**2, 2 / self.v**3)

    def __neg__(self) -> Dual:
        return self * -1.0

    def __sub__(self, o) -> Dual:
        return self + -o

    def __rsub__(self, o) -> Dual:
        return -self + o

    def __truediv__(self, o) -> Dual:
        return self * (o.inverse() if isinstance(o, Dual) else 1 / o)

    def __rtruediv__(self, o) -> Dual:
        return self.inverse() * o

    __radd__, __rmul__ = __add__, __mul__


def variables(values: Sequence[np.ndarray]) -> list[Dual]:
    """Each array as a variable of its own."""
    m, n = len(values), len(values[0])
    unit = np.eye(m)
    none = np.zeros((m, m, n))
    return [Dual(np.asarray(v, float), np.repeat(unit[i][:, None], n, axis=1), none) for i, v in enumerate(values)]


def exp(x):
    if not isinstance(x, Dual):
        return np.exp(x)
    v = np.exp(x.v)
    return x.mapped(v, v, v)


def log(x):
    return x.mapped(np.log(x.v), 1 / x.v, -1 / x.v**2) if isinstance(x, Dual) else np.log(x)


def sigmoid(x):
    if not isinstance(x, Dual):
        return 1 / (1 + np.exp(-x))
    v = 1 / (1 + np.exp(-x.v))
    d = v * (1 - v)
    return x.mapped(v, d, d * (1 - 2 * v))


def where(condition: np.ndarray, x, y):
    """``x`` where the condition holds, else ``y`` (either may be plain)."""
    if not isinstance(x, Dual) and not isinstance(y, Dual):
        return np.where(condition, x, y)
    part = lambda o, k: getattr(o, k) if isinstance(o, Dual) else (o if k == "v" else 0.0)
    return Dual(*(np.where(condition, part(x, k), part(y, k)) for k in ("v", "g", "h")))


def at_least(x, floor: float):
    """``x``, or the constant where it is below."""
    return where((x.v if isinstance(x, Dual) else x) > floor, x, floor)


def between(x, low: float, high: float):
    """``x``, or the constant bound it is beyond."""
    v = x.v if isinstance(x, Dual) else x
    return where(v < low, low, where(v > high, high, x))
