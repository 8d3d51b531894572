"""Many fits over rows that stay on the executors: one aggregate a round evaluates all of them.

A job is a model with coefficients of its own and a weight for every row: all rows, the rows outside (or
inside) a fold, or Poisson draws of a bootstrap replicate, which follow from the row and the replicate and
are made anew where they are needed.  A task adds its rows up for every job and sends one block of sums;
rounds, and so Spark jobs, don't grow with the number of fits.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.dist import normal_quantile
from fieldmark.operators.model import Model, Penalty, Problem, bounds, get_model, point, predictors, problem, sums
from fieldmark.operators.optimise import Optimum, Point, strategy_named, together

#: Column with a hash of each row, from which draws follow.
DRAW = "draw"


@dataclass(frozen=True)
class Job:
    """A fit: design columns and names of the coefficients, weight of rows (see :func:`weights`), sum of the weights."""

    columns: Sequence[Sequence[str]]
    names: Sequence[tuple[str, str]]
    weight: tuple = ("all",)
    total: float = 1.0


def poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson draws by inversion; above 500 by the normal curve."""
    mean = mean.astype(float)
    out = np.zeros(len(mean))
    term = np.exp(-np.minimum(mean, 500))
    total, k = term.copy(), 0
    while (open_ := (u > total) & (mean <= 500) & (term > 0)).any():
        k += 1
        term = term * mean / k
        out[open_] += 1
        total = total + term
    big = mean > 500
    if big.any():
        out[big] = np.maximum(0, np.round(mean[big] + np.sqrt(mean[big]) * np.array([normal_quantile(float(x)) for x in u[big]])))
    return out


def uniforms(key: np.ndarray, rep: int) -> np.ndarray:
    """Numbers in (0, 1) by row hash and replicate (a bit mixer of 64-bit integers)."""
    with np.errstate(over="ignore"):
        x = key.astype(np.int64).view(np.uint64) + np.uint64(rep + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def weights(pdf: pd.DataFrame, how: tuple) -> np.ndarray:
    """Counts of rows for a job: ("all",), ("not", column, value), ("only", column, value) or ("drawn", replicate)."""
    n = pdf["n"].to_numpy(float)
    if how[0] == "all":
        return n
    if how[0] == "drawn":
        return poisson(n, uniforms(pdf[DRAW].to_numpy(), how[1]))
    same = pdf[how[1]].to_numpy() == how[2]
    return n * (same if how[0] == "only" else ~same)


def added(rows: DataFrame, jobs: Mapping[Hashable, Job], occasions: int, width: Callable[[Job], int], each: Callable[[Hashable, Job, Problem, pd.DataFrame], np.ndarray]) -> dict[Hashable, np.ndarray]:
    """For every job the sum over all rows of ``each``, an array of ``width`` numbers, in one aggregate."""
    keys = list(jobs)
    cut = np.cumsum([0, *[width(jobs[k]) for k in keys]])
    size = int(cut[-1])

    def run(batches):
        part = np.zeros(size)
        for pdf in batches:
            if not len(pdf):
                continue
            made: dict[tuple, tuple] = {}
            for i, k in enumerate(keys):
                job = jobs[k]
                of = tuple(map(tuple, job.columns))
                q = made[of] if of in made else made.setdefault(of, problem(pdf, job.columns, occasions))
                q = Problem(q.x, q.e, q.l, weights(pdf, job.weight), q.designs, occasions)
                part[cut[i] : cut[i + 1]] += each(k, job, q, pdf)
        yield pd.DataFrame({"cell": np.arange(size), "s": part})

    out = np.zeros(size)
    got = rows.mapInPandas(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toPandas()  # a block of sums
    out[got["cell"].to_numpy()] = got["s"].to_numpy()
    return {k: out[cut[i] : cut[i + 1]] for i, k in enumerate(keys)}


def evaluated(rows: DataFrame, jobs: Mapping[Hashable, Job], occasions: int, at: Mapping[Hashable, np.ndarray], penalty: Penalty, model: Model) -> dict[Hashable, Point]:
    """The objective of each job at its coefficients ``at``."""
    asked = {k: jobs[k] for k in at}
    width = lambda job: 2 + len(job.names) + len(job.names) ** 2
    total = added(rows, asked, occasions, width, lambda k, job, q, _: sums(at[k], q, penalty, job.total, model.rows))
    return {k: point(at[k], total[k], penalty, penalty.mask(job.names)) for k, job in asked.items()}


def fitted(rows: DataFrame, jobs: Mapping[Hashable, Job], starts: Mapping[Hashable, np.ndarray], occasions: int, how) -> dict[Hashable, Optimum]:
    """The optimum of every job, in step; ``rows`` should be persisted."""
    model = get_model(how.model)
    limits = {k: bounds(job.names, model) for k, job in jobs.items()}
    steps = {k: strategy_named(how.strategy)(starts[k], *limits[k], watch=how.watch) for k in jobs}
    return together(steps, lambda at: evaluated(rows, jobs, occasions, at, how.penalty, model))


def growths(rows: DataFrame, jobs: Mapping[Hashable, Job], occasions: int, at: Mapping[Hashable, np.ndarray], model: Model) -> dict[Hashable, float | None]:
    """Mean growth rate over each job's rows."""
    if model.growth is None:
        return dict.fromkeys(jobs)
    got = added(rows, jobs, occasions, lambda _: 2, lambda k, _, q, __: np.array([q.n @ model.growth(predictors(at[k], q)), q.n.sum()]))
    return {k: float(v[0] / v[1]) for k, v in got.items()}


def held_out(rows: DataFrame, jobs: Mapping[Hashable, Job], occasions: int, at: Mapping[Hashable, np.ndarray], model: Model) -> dict[Hashable, tuple[float, float]]:
    """Log-likelihood and individuals of the fold that each job leaves out."""
    judged = {k: Job(job.columns, job.names, ("only", *job.weight[1:])) for k, job in jobs.items()}
    one = lambda k, _, q, __: np.array([q.n @ model.rows(predictors(at[k], q), q, Penalty(), 1.0)[0], q.n.sum()])
    return {k: (float(v[0]), float(v[1])) for k, v in added(rows, judged, occasions, lambda _: 2, one).items()}
