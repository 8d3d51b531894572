"""Maximum-likelihood fits: one model, many models, refits on resamples and folds.

Spark compresses the data to grouped counts; where these are ``LOCAL_ROWS`` at most, each fit works on arrays in a task of its
own.  Where more remain (continuous covariates), the rows stay on the executors, and all fits of a call go in step: a
round is one Spark aggregate of every fit's value, gradient and Hessian (:mod:`fieldmark.operators.many`).
Log-likelihoods and criteria that are reported are without priors and penalties.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions.dist import t_quantile
from fieldmark.functions.formula import Data, Formula, FormulaError, describe, design, domain_checks, parse
from fieldmark.operators import many
from fieldmark.operators.many import DRAW, Job, weights
from fieldmark.operators.model import (
    BOUNDS, EPS, LIMIT, MODELS, NO_PENALTY, PARAMETERS, Model, Penalty, Problem, bounds, get_model, point, predictors, problem, register_model, rows_of_model, sums, value_and_gradient,
)
from fieldmark.operators.optimise import STRATEGIES, Optimum, Point, alone, strategy_named
from fieldmark.operators.suffstat import rates_of, runs, starting_values
from fieldmark.sources.histories import CaptureFrame

__all__ = [
    "BOUNDS", "EPS", "LIMIT", "MODELS", "PARAMETERS", "STRATEGIES", "Model", "Penalty", "Point", "Problem", "Spec", "get_model", "point", "register_model", "rows_of_model", "sums", "value_and_gradient",
]

LOCAL_ROWS = 200_000


#: Strategy by how difficult a problem is (see ``monitor.difficulty``).
CHOICE = {"easy": "newton", "moderate": "newton", "difficult": "hybrid", "very_difficult": "multi_start"}


def chosen(frame: CaptureFrame, parameters: int) -> str:
    """The strategy for a data set and a number of coefficients."""
    from fieldmark.operators.monitor import difficulty

    cells = F.count(F.lit(1)) * F.lit(float(frame.occasions))
    one = frame.df.agg((F.lit(float(parameters)) / F.count(F.lit(1))).alias("ratio"), (1.0 - F.sum("x") / cells).alias("sparsity"))
    label = one.select(difficulty(F.col("ratio"), F.col("sparsity"), F.lit(frame.occasions), F.lit(parameters))).first()[0]
    return CHOICE[label]


@dataclass(frozen=True)
class Spec:
    """A candidate model: a formula for each parameter; ``more`` holds those of parameters other than phi, p and f."""

    phi: str = "~1"
    p: str = "~1"
    f: str = "~1"
    name: str = ""
    more: tuple[tuple[str, str], ...] = ()

    @property
    def label(self) -> str:
        return self.name or f"phi({self.phi}) p({self.p}) f({self.f})" + "".join(f" {k}({v})" for k, v in self.more)

    def formulas(self, parameters: Sequence[str] = PARAMETERS) -> dict[str, Formula]:
        other = dict(self.more)
        return {k: parse(other.get(k, "~1") if k not in PARAMETERS else getattr(self, k)) for k in parameters}


FIT_SCHEMA = (
    "model_id int, model_name string, phi string, p string, f string, strategy string, converged boolean, log_likelihood double, n_parameters int, n long, "
    "aic double, aicc double, bic double, n_iterations int, lambda_mean double, "
    "params array<struct<param:string,term:string,idx:int,estimate:double,se:double,ci_lower:double,ci_upper:double,at_bound:boolean>>, "
    "trace array<struct<iteration:int,value:double,gradient:double>>"
)


def criteria(ll: float, k: int, n: int) -> tuple[float, float, float]:
    aic = 2 * k - 2 * ll
    return aic, aic + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf, k * math.log(max(n, 1)) - 2 * ll


def _result(model_id: int, spec: Spec, names: Sequence[tuple[str, str]], best: Optimum, n: int, lam: float | None, lower, upper) -> dict:
    at_bound = (best.theta <= lower + 1e-9) | (best.theta >= upper - 1e-9)
    se = np.full(len(best.theta), np.nan)
    free = ~at_bound
    if free.any():
        cov = np.linalg.pinv(-best.at.h[np.ix_(free, free)])
        se[free] = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), np.nan))
    k = len(best.theta)
    z = 1.959963984540054 if n - k > 30 else t_quantile(0.975, max(30, n - k))
    aic, aicc, bic = criteria(best.at.ll, k, n)
    some = lambda v: None if np.isnan(v) else float(v)
    params = [
        {"param": a, "term": t, "idx": i, "estimate": float(best.theta[i]), "se": some(se[i]), "ci_lower": some(best.theta[i] - z * se[i]), "ci_upper": some(best.theta[i] + z * se[i]), "at_bound": bool(at_bound[i])}
        for i, (a, t) in enumerate(names)
    ]
    return {
        "model_id": model_id, "model_name": spec.label, "phi": spec.phi, "p": spec.p, "f": spec.f, "strategy": best.strategy, "converged": bool(best.converged),
        "log_likelihood": best.at.ll, "n_parameters": k, "n": int(n), "aic": aic, "aicc": aicc, "bic": bic, "n_iterations": best.iterations, "lambda_mean": lam, "params": params,
        "trace": [{"iteration": i, "value": v, "gradient": g} for i, v, g in best.trace],
    }


@dataclass(frozen=True)
class How:
    """How to fit: strategy, penalty, model, and what to call at every iteration."""

    strategy: str = "hybrid"
    penalty: Penalty = NO_PENALTY
    model: str = "temporal_symmetry"
    watch: Callable[[int, float, float], None] | None = None


def _optimum(q: Problem, names, start: np.ndarray, how: How) -> Optimum:
    """The fit to rows as arrays."""
    model, mask, total = get_model(how.model), how.penalty.mask(names), float(q.n.sum())
    evaluate = lambda theta: point(theta, sums(theta, q, how.penalty, total, model.rows), how.penalty, mask)
    return alone(strategy_named(how.strategy)(start, *bounds(names, model), watch=how.watch), evaluate)


def _fit_local(pdf: pd.DataFrame, model_id: int, spec: Spec, columns, names, base, occasions: int, how: How) -> dict:
    q, model = problem(pdf, columns, occasions), get_model(how.model)
    best = _optimum(q, names, _start(pdf, names, occasions, base), how)
    lam = float(model.growth(predictors(best.theta, q)) @ q.n / q.n.sum()) if model.growth else None
    return _result(model_id, spec, names, best, int(q.n.sum()), lam, *bounds(names, model))


def _start(pdf: pd.DataFrame, names, occasions: int, base: Mapping[str, float] | None) -> np.ndarray:
    """From the rows' own rates; intercepts from ``base`` where given."""
    start = starting_values(rates_of(pdf, occasions), names)
    return np.array([base[a] if base and t == "(Intercept)" else x for (a, t), x in zip(names, start)])


@dataclass(frozen=True)
class _Prepared:
    """Rows (x, e, l, design columns, ``extra``, n, again, before) of all models together, not yet grouped."""

    rows: DataFrame
    columns: dict[int, list[list[str]]]
    names: dict[int, list[tuple[str, str]]]
    occasions: int
    continuous: bool
    base: dict[str, float] | None = None

    @property
    def key(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("n", "again", "before")]

    def grouped(self) -> DataFrame:
        return self.rows.groupBy(*self.key).agg(*[F.sum(c).alias(c) for c in ("n", "again", "before")])

    def settled(self, most: int) -> tuple[pd.DataFrame | None, DataFrame | None]:
        """(the grouped rows, None) if they are ``most`` at most, else (None, rows to leave on the executors).

        With continuous covariates the number of different rows is estimated first: where they are
        nearly all different, nothing is grouped, and no shuffle made.
        """
        if self.continuous:
            n, kinds = self.rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*self.key))).first()
            if kinds > 1.2 * most + 10:
                return None, self.grouped() if kinds < n / 2 else self.rows
        few = self.grouped().limit(most + 1).toPandas()
        return (few, None) if len(few) <= most else (None, self.grouped())

    def job(self, i: int, total: float, weight: tuple = ("all",)) -> Job:
        return Job(self.columns[i], self.names[i], weight, total)


def _prepare(frame: CaptureFrame, specs: Mapping[int, Spec], model: str = "temporal_symmetry", extra: Sequence[tuple[str, object]] = ()) -> _Prepared:
    """All models' design columns, once each, beside (x, e, l) and ``extra``."""
    parameters = get_model(model).parameters
    formulas = {i: s.formulas(parameters) for i, s in specs.items()}
    used = tuple(dict.fromkeys(v for fs in formulas.values() for fo in fs.values() for v in fo.variables))
    data: Data = describe(frame.df, used, frame.occasions)
    checks = [c for fs in formulas.values() for fo in fs.values() for c in domain_checks(fo)]
    if checks:
        bad = frame.df.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(checks)]).first()
        for i, (message, _) in enumerate(checks):
            if bad[i]:
                raise FormulaError(f"{message}; {bad[i]} rows don't have them")
    column: dict[str, tuple[str, object]] = {}
    made = {i: {k: design(fs[k], data) for k in parameters} for i, fs in formulas.items()}
    for of in made.values():
        for cols in of.values():
            for name, c in cols:
                column.setdefault(name, (f"d{len(column)}", c))
    columns = {i: [[column[n][0] for n, _ in of[k]] for k in parameters] for i, of in made.items()}
    names = {i: [(k, n) for k in parameters for n, _ in of[k]] for i, of in made.items()}
    sums_ = [c.cast("long").alias(k) for k, c in zip(("again", "before"), runs(frame.occasions, "h"))]
    rows = frame.df.select("x", "e", "l", *[c.alias(n) for n, c in column.values()], *[c.alias(n) for n, c in extra], F.lit(1).cast("long").alias("n"), *sums_)
    return _Prepared(rows, columns, names, frame.occasions, any(v not in data.levels for v in used))


def _whole(rows: DataFrame) -> pd.DataFrame:
    """What starting values need: sums by first capture and number of captures (occasions squared at most)."""
    return rows.groupBy("x", "e").agg(*[F.sum(c).alias(c) for c in ("n", "again", "before")]).toPandas()


def _fit_distributed(p: _Prepared, rows: DataFrame, specs: Mapping[int, Spec], how: How) -> dict[int, tuple[dict, Optimum]]:
    """All models in step, over rows on the executors."""
    rows = rows.persist()
    try:
        whole, model = _whole(rows), get_model(how.model)
        n = float(whole["n"].sum())
        jobs = {i: p.job(i, n) for i in specs}
        best = many.fitted(rows, jobs, {i: _start(whole, p.names[i], p.occasions, p.base) for i in specs}, p.occasions, how)
        lam = many.growths(rows, jobs, p.occasions, {i: b.theta for i, b in best.items()}, model)
        return {i: (_result(i, s, p.names[i], best[i], int(n), lam[i], *bounds(p.names[i], model)), best[i]) for i, s in specs.items()}
    finally:
        rows.unpersist()


def _warmed(frame: CaptureFrame, p: _Prepared, how: How, local_rows: int) -> _Prepared:
    """Starts with the intercepts of a fit without covariates."""
    return replace(p, base={q["param"]: q["estimate"] for q in fit(frame, Spec(), how.strategy, local_rows, model=how.model)["params"]})


def fit(
    frame: CaptureFrame, spec: Spec = Spec(), strategy: str = "hybrid", local_rows: int = LOCAL_ROWS, penalty: Penalty = NO_PENALTY,
    warm_start: bool = False, model: str = "temporal_symmetry", watch=None,
) -> dict:
    """One model; a row of ``FIT_SCHEMA`` as a dict.  ``strategy`` "auto" picks one by difficulty."""
    p = _prepare(frame, {0: spec}, model)
    how = How(chosen(frame, len(p.names[0])) if strategy == "auto" else strategy, penalty, model, watch)
    strategy_named(how.strategy)
    if warm_start:
        p = _warmed(frame, p, how, local_rows)
    few, rows = p.settled(local_rows)
    if few is None:
        return _fit_distributed(p, rows, {0: spec}, how)[0][0]
    return _fit_local(few, 0, spec, p.columns[0], p.names[0], p.base, frame.occasions, how)


def _each(spark: SparkSession, few: pd.DataFrame, schema, n: int, run: Callable[[int, pd.DataFrame], pd.DataFrame], out: str) -> DataFrame:
    """``run(i, rows)`` for each i below ``n``, in a partition of its own; the rows, a bounded table, are broadcast."""
    rows = F.broadcast(spark.createDataFrame(few, schema))

    def whole(batches):
        got = list(batches)
        if got and len(pdf := pd.concat(got, ignore_index=True)):
            yield run(int(pdf["job"].iloc[0]), pdf.drop(columns="job"))

    return spark.range(0, n, 1, n).select(F.col("id").cast("int").alias("job")).crossJoin(rows).mapInPandas(whole, out)


def fit_models(
    frame: CaptureFrame, specs: Sequence[Spec], strategy: str = "hybrid", done: DataFrame | None = None, local_rows: int = LOCAL_ROWS,
    penalty: Penalty = NO_PENALTY, warm_start: bool = False, model: str = "temporal_symmetry", store: str | None = None,
) -> DataFrame:
    """All models in one job: the grouped counts go to a task for each model.

    Where grouping leaves more than ``local_rows`` rows, the models are fitted in step by distributed
    evaluations.  ``done`` (with model_id) holds fits of an earlier run, which are not repeated.  With ``store`` (a folder) every
    model is written there once its own fit is done, so that a job that fails or is stopped keeps the finished
    ones, and the same call goes on from them; the result is then read from the folder.
    """
    spark: SparkSession = frame.df.sparkSession
    todo = dict(enumerate(specs))
    if store is not None:
        kept = _stored_fits(spark, store)
        if kept is not None:
            done = kept if done is None else done.select("model_id").unionByName(kept.select("model_id"))
    if done is not None:
        gone = {r["model_id"] for r in done.select("model_id").distinct().collect()}  # a row a model
        todo = {i: s for i, s in todo.items() if i not in gone}
    fits = _fit_todo(frame, todo, How(strategy, penalty, model), local_rows, warm_start) if todo else spark.createDataFrame([], FIT_SCHEMA)
    if store is None:
        return fits
    if todo:
        # a task's file is moved into place when the task ends, not when the job does
        fits.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)
    return _stored_fits(spark, store) or fits


def _stored_fits(spark: SparkSession, store: str) -> DataFrame | None:
    """Fits in a folder, one a model (a retried task may have written one twice); None if there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return None
    return spark.read.schema(FIT_SCHEMA).parquet(store).dropDuplicates(["model_id"])


def _fit_todo(frame: CaptureFrame, todo: dict[int, Spec], how: How, local_rows: int, warm_start: bool) -> DataFrame:
    spark, p, occasions = frame.df.sparkSession, _prepare(frame, todo, how.model), frame.occasions
    if warm_start:
        p = _warmed(frame, p, how, local_rows)
    few, rows = p.settled(local_rows)
    if few is None:
        return spark.createDataFrame([r for r, _ in _fit_distributed(p, rows, todo, how).values()], FIT_SCHEMA)
    ids, p_columns, p_names, base, model = list(todo), p.columns, p.names, p.base, get_model(how.model)

    def run(job: int, pdf: pd.DataFrame) -> pd.DataFrame:
        i = ids[job]
        cols = p_columns[i]
        register_model(model)  # a task's registry has only the library's own
        need = list(dict.fromkeys(c for cs in cols for c in cs))
        own = pdf.groupby(["x", "e", "l", *need], as_index=False)[["n", "again", "before"]].sum()
        return pd.DataFrame([_fit_local(own, i, todo[i], cols, p_names[i], base, occasions, how)])

    return _each(spark, few, p.grouped().schema, len(ids), run, FIT_SCHEMA)


def hessian_quality(h: np.ndarray) -> str:
    """Whether second derivatives can be trusted: "identity", "zero", "not_concave" or "good" (of a maximum)."""
    d = np.diag(h)
    if np.allclose(np.abs(d), 1.0, atol=1e-8) and np.allclose(h - np.diag(d), 0.0, atol=1e-8):
        return "identity"
    if np.abs(h).max(initial=0.0) < 1e-10:
        return "zero"
    return "good" if (np.linalg.eigvalsh(h) < 0).all() else "not_concave"


FLOOR = 1e-10


def covariance(frame: CaptureFrame, spec: Spec = Spec(), strategy: str = "hybrid", local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(row, col, information, covariance, correlation, condition, hessian) of the coefficients; null where one is on a bound.

    ``condition`` is the free information's condition number (a pseudo-inverse stands in for the
    inverse above 1e12); variances are 1e-10 at least.
    """
    p, how = _prepare(frame, {0: spec}), How(strategy)
    names = p.names[0]
    lower, upper = bounds(names, get_model(how.model))
    few, rows = p.settled(local_rows)
    if few is not None:
        best = _optimum(problem(few, p.columns[0], frame.occasions), names, _start(few, names, frame.occasions, None), how)
    else:
        best = _fit_distributed(p, rows, {0: spec}, how)[0][1]
    info = -best.at.h
    free = (best.theta > lower + 1e-9) & (best.theta < upper - 1e-9)
    cov, condition = np.full_like(info, np.nan), math.nan
    if free.any():
        inner = info[np.ix_(free, free)]
        condition = float(np.linalg.cond(inner))
        cov[np.ix_(free, free)] = np.linalg.inv(inner) if condition < 1e12 else np.linalg.pinv(inner)
        d = np.flatnonzero(free)
        cov[d, d] = np.maximum(cov[d, d], FLOOR)
    sd = np.sqrt(np.diag(cov))
    some = lambda v: None if np.isnan(v) else float(v)
    label = [f"{a}_{t}" for a, t in names]
    k = range(len(label))
    quality = hessian_quality(best.at.h[np.ix_(free, free)])
    found = [(label[i], label[j], some(info[i, j]), some(cov[i, j]), some(cov[i, j] / (sd[i] * sd[j])), some(condition), quality) for i in k for j in k]
    return frame.df.sparkSession.createDataFrame(found, "row string, col string, information double, covariance double, correlation double, condition double, hessian string")


def strategies_compared(frame: CaptureFrame, spec: Spec = Spec(), names: Sequence[str] = ("newton", "multi_start", "adam")) -> DataFrame:
    """A fit by each strategy: log-likelihood, convergence, iterations."""
    p = _prepare(frame, {0: spec})
    few, left = p.settled(LOCAL_ROWS)

    def by(s: str) -> dict:
        if few is None:
            return _fit_distributed(p, left, {0: spec}, How(s))[0][0]
        return _fit_local(few, 0, spec, p.columns[0], p.names[0], None, frame.occasions, How(s))

    rows = [(s, (r := by(s))["log_likelihood"], r["converged"], r["n_iterations"]) for s in names]
    return frame.df.sparkSession.createDataFrame(rows, "strategy string, log_likelihood double, converged boolean, n_iterations int")


def formula_grid(phi: Sequence[str], p: Sequence[str], f: Sequence[str]) -> list[Spec]:
    """All combinations, phi outermost."""
    return [Spec(a, b, c) for a in phi for b in p for c in f]


def coefficients(frame: CaptureFrame, specs: Sequence[Spec]) -> DataFrame:
    """(model_id, phi, p, f, n_parameters): how many coefficients each candidate has on this data set."""
    names = _prepare(frame, dict(enumerate(specs))).names
    rows = [(i, s.phi, s.p, s.f, len(names[i])) for i, s in enumerate(specs)]
    return frame.df.sparkSession.createDataFrame(rows, "model_id int, phi string, p string, f string, n_parameters int")


def parameters(fits: DataFrame) -> DataFrame:
    """fit_params: a row for each coefficient."""
    return fits.select("model_id", F.explode("params").alias("q")).select("model_id", "q.*")


BOOT_SCHEMA = "rep int, param string, term string, estimate double, converged boolean"


def bootstrap(
    frame: CaptureFrame, spec: Spec = Spec(), replicates: int = 100, seed: int = 42, local_rows: int = LOCAL_ROWS,
    fit_fn: Callable[[pd.DataFrame], Mapping[tuple[str, str], float]] | None = None,
) -> DataFrame:
    """(rep, param, term, estimate, converged): refits on resampled individuals; a replicate that fails has null estimates.

    Resampling n individuals with replacement is a multinomial draw over the grouped counts, made in
    each replicate's task.  Above ``local_rows`` grouped rows, every row has a Poisson weight in each replicate, and all
    replicates are fitted in step, so that a round is one job however many there are.  ``fit_fn`` stands in for the fit: it gets
    grouped rows (x, e, l, design columns, n) and returns estimates by (param, term); above ``local_rows`` it is refused.
    """
    p, occasions, spark = _prepare(frame, {0: spec}), frame.occasions, frame.df.sparkSession
    cols, names, how = p.columns[0], p.names[0], How()
    few, _ = p.settled(local_rows)

    def rows_of(rep: int, found: Mapping[tuple[str, str], float] | None) -> list[tuple]:
        return [(rep, a, t, found.get((a, t)) if found is not None else None, found is not None) for a, t in names]

    if few is None:
        if fit_fn:
            raise ValueError(f"a fit function gets whole replicates, and this table has more than {local_rows} different rows")
        # rows drawn by their hash have to be different rows
        rows = p.grouped().withColumn(DRAW, F.xxhash64(F.lit(seed), *p.key)).persist()
        try:
            whole = _whole(rows)
            start = _start(whole, names, occasions, None)
            jobs = {r: p.job(0, float(whole["n"].sum()), ("drawn", r)) for r in range(replicates)}
            best = many.fitted(rows, jobs, dict.fromkeys(jobs, start), occasions, how)
        finally:
            rows.unpersist()
        found = {r: dict(zip(names, b.theta.tolist())) if b.converged else None for r, b in best.items()}
        return spark.createDataFrame([x for r in jobs for x in rows_of(r, found[r])], BOOT_SCHEMA)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in pdf.columns if c not in ("rep", "n")])
        n = sizes = pdf["n"].to_numpy()
        drawn = np.random.default_rng([seed, int(key[0])]).multinomial(n.sum(), n / n.sum())
        sample = pdf.assign(n=drawn)[drawn > 0]
        if fit_fn:
            found = fit_fn(sample.drop(columns="rep"))
        else:
            share = sample["n"] / sizes[drawn > 0]
            got = _fit_local(sample.assign(again=sample["again"] * share, before=sample["before"] * share), 0, spec, cols, names, None, occasions, how)
            found = {(q["param"], q["term"]): q["estimate"] for q in got["params"]} if got["converged"] else None
        return pd.DataFrame(rows_of(int(key[0]), found), columns=["rep", "param", "term", "estimate", "converged"])

    reps = spark.range(replicates).select(F.col("id").cast("int").alias("rep"))
    rows = spark.createDataFrame(few, p.grouped().schema)  # local_rows at most
    return rows.crossJoin(F.broadcast(reps)).groupBy("rep").applyInPandas(run, BOOT_SCHEMA)


def bootstrap_summary(reps: DataFrame, estimates: DataFrame | None = None) -> DataFrame:
    """Per coefficient: replicates and failures, mean, standard error, 95 % and 99 % intervals; with ``estimates``
    (param, term, estimate) bias and the bias-corrected estimate.  Over half failures are an error when the table is used."""
    at = lambda q: F.percentile("estimate", F.lit(q))
    out = reps.groupBy("param", "term").agg(
        F.count(F.lit(1)).alias("replicates"), F.count_if(~F.col("converged")).alias("failed"), F.avg("estimate").alias("mean"), F.stddev_samp("estimate").alias("se"),
        at(0.025).alias("ci_lower"), at(0.975).alias("ci_upper"), at(0.005).alias("ci99_lower"), at(0.995).alias("ci99_upper"),
    )
    many = F.col("failed") * 2 > F.col("replicates")
    out = out.withColumn("failed", F.when(many, F.raise_error(F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("replicates").cast("string"), F.lit(" bootstrap fits failed"))).cast("long")).otherwise(F.col("failed")))
    if estimates is None:
        return out
    out = out.join(estimates.select("param", "term", "estimate"), ["param", "term"])
    return out.withColumn("bias", F.col("mean") - F.col("estimate")).withColumn("corrected", F.col("estimate") - F.col("bias"))


def bootstrap_covariance(reps: DataFrame) -> DataFrame:
    """(row, col, covariance, correlation) of estimates over replicates (a replicate has few coefficients)."""
    label = F.concat_ws("_", "param", "term")
    a, b = (reps.where("converged").select("rep", label.alias(x), F.col("estimate").alias(f"v_{x}")) for x in ("row", "col"))
    both = a.join(b, "rep").groupBy("row", "col")
    out = both.agg(F.covar_samp("v_row", "v_col").alias("covariance"), F.stddev_samp("v_row").alias("_s"), F.stddev_samp("v_col").alias("_t"))
    return out.withColumn("correlation", F.try_divide(F.col("covariance"), F.col("_s") * F.col("_t"))).drop("_s", "_t")


def predicted(frame: CaptureFrame, row: Mapping) -> DataFrame:
    """``frame.df`` with phi, p, f, lambda and log_likelihood of each individual under a fit (a row of ``FIT_SCHEMA``)."""
    from fieldmark.functions import links

    formulas = Spec(row["phi"], row["p"], row["f"]).formulas()
    used = tuple(dict.fromkeys(v for fo in formulas.values() for v in fo.variables))
    data = describe(frame.df, used, frame.occasions)
    eta = {}
    for k in PARAMETERS:
        own = [q["estimate"] for q in sorted((q for q in row["params"] if q["param"] == k), key=lambda q: q["idx"])]
        eta[k] = links.linear(design(formulas[k], data), own)
    out = frame.df.withColumns({"phi": links.inv_logit(eta["phi"]), "p": links.inv_logit(eta["p"]), "f": F.exp(eta["f"])})
    return out.withColumns({"lambda": F.col("phi") + F.col("f"), "log_likelihood": links.log_likelihood("phi", "p", "f", frame.occasions)})


def prediction_summary(rates: DataFrame, n_parameters: int) -> DataFrame:
    """One row over predicted individuals: mean and sd (over n) of phi, p and f, the growth rate's summary, log-likelihood and AIC."""
    from fieldmark.operators.infer import growth_summary

    grow = growth_summary(rates, F.col("lambda"))
    each = [g(k).alias(f"{k}_{s}") for k in PARAMETERS for g, s in ((F.avg, "mean"), (F.stddev_pop, "sd"))]
    one = rates.agg(*each, F.sum("log_likelihood").alias("log_likelihood")).withColumn("aic", 2.0 * n_parameters - 2.0 * F.col("log_likelihood"))
    return one.crossJoin(F.broadcast(grow.select(*[F.col(c).alias(f"lambda_{c}") for c in grow.columns])))  # one row each


VALIDATION_SCHEMA = "model_id int, repeat int, fold int, train_ll double, train_n long, val_ll double, val_n long, n_parameters int, converged boolean, params array<struct<param:string,term:string,estimate:double>>"


def cross_validated(
    frame: CaptureFrame, specs: Sequence[Spec], k: int = 5, repeats: int = 1, seed: int = 42, id_col: str = "id",
    share: float | None = None, local_rows: int = LOCAL_ROWS,
) -> DataFrame:
    """Fits on the rest of each fold, judged on the fold: a row for each model, repeat and fold.

    Folds are hash ranges of the id; with ``share``, one split with that share held out instead.  Each fit is a task over
    the grouped rows; above ``local_rows`` of these all models and folds are fitted in step over rows on the executors.
    """
    from fieldmark.operators.sampling import uniform

    spark, occasions, how = frame.df.sparkSession, frame.occasions, How()
    todo = dict(enumerate(specs))
    fold = lambda r: (F.floor(uniform(seed + r, id_col) * k) if share is None else (uniform(seed + r, id_col) >= share)).cast("int")
    p = _prepare(frame, todo, extra=[(f"part{r}", fold(r)) for r in range(repeats)])
    keys = [(i, r, j) for i in todo for r in range(repeats) for j in (range(k) if share is None else (0,))]
    few, rows = p.settled(local_rows)

    def row(key, train_ll, train_n, val_ll, val_n, converged, theta) -> dict:
        params = [{"param": a, "term": t, "estimate": float(v)} for (a, t), v in zip(p_names[key[0]], theta)]
        return {
            "model_id": key[0], "repeat": key[1], "fold": key[2], "train_ll": train_ll, "train_n": int(train_n), "val_ll": val_ll, "val_n": int(val_n),
            "n_parameters": len(params), "converged": bool(converged), "params": params,
        }

    p_columns, p_names = p.columns, p.names
    if few is None:
        rows = rows.persist()
        try:
            whole = _whole(rows)
            size = rows.groupBy(*[F.col(f"part{r}") for r in range(repeats)]).agg(F.sum("n").alias("n")).toPandas()  # a row a combination of folds
            weight = {key: ("not", f"part{key[1]}", key[2]) for key in keys}
            total = {key: float(weights(size, weight[key]).sum()) for key in keys}
            jobs = {key: p.job(key[0], total[key], weight[key]) for key in keys}
            best = many.fitted(rows, jobs, {key: _start(whole, p.names[key[0]], occasions, None) for key in keys}, occasions, how)
            judged = many.held_out(rows, jobs, occasions, {key: b.theta for key, b in best.items()}, get_model(how.model))
        finally:
            rows.unpersist()
        return spark.createDataFrame([row(key, best[key].at.ll, total[key], *judged[key], best[key].converged, best[key].theta) for key in keys], VALIDATION_SCHEMA)

    def run(job: int, pdf: pd.DataFrame) -> pd.DataFrame:
        key = keys[job]
        cols, names = p_columns[key[0]], p_names[key[0]]
        out = (pdf[f"part{key[1]}"] == key[2]).to_numpy()
        train = problem(pdf[~out], cols, occasions)
        best = _optimum(train, names, _start(pdf[~out], names, occasions, None), how)
        val = sums(best.theta, problem(pdf[out], cols, occasions))[0] if out.any() else 0.0
        return pd.DataFrame([row(key, best.at.ll, train.n.sum(), float(val), pdf.loc[out, "n"].sum(), best.converged, best.theta)])

    return _each(spark, few, p.grouped().schema, len(keys), run, VALIDATION_SCHEMA)


def selection_workflow(frame: CaptureFrame, specs: Sequence[Spec], share: float = 0.2, seed: int = 42, id_col: str = "id", local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Fit on a training part, judge on the rest, compare: ranks by AIC and by loss, weights, overfitting and its label."""
    from fieldmark.operators.select import comparison, overfitting_label

    rows = cross_validated(frame, specs, repeats=1, seed=seed, id_col=id_col, share=share, local_rows=local_rows).drop("repeat", "fold", "params")
    rows = rows.withColumns({
        "aic": 2.0 * F.col("n_parameters") - 2.0 * F.col("train_ll"), "loss": F.try_divide(-F.col("val_ll"), F.col("val_n")),
        "overfitting": F.abs(F.try_divide(F.col("train_ll") / F.col("train_n") - F.try_divide(F.col("val_ll"), F.col("val_n")), F.col("train_ll") / F.col("train_n"))),
    })
    from pyspark.sql import Window

    out = comparison(rows.where("converged")).withColumnRenamed("rank", "ic_rank")
    return out.withColumn("loss_rank", F.row_number().over(Window.orderBy("loss", "model_id"))).withColumn("label", overfitting_label(F.col("overfitting")))
