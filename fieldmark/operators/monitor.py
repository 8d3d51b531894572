"""Summaries of optimisation traces and task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_traces(fits: DataFrame, session: str = "model_id") -> DataFrame:
    """The iterations of fits (``FIT_SCHEMA``) as a trace: (session_id, iteration, objective to be made small, grad_norm, strategy, success)."""
    each = fits.select(F.col(session).alias("session_id"), "strategy", F.col("converged").alias("success"), F.explode("trace").alias("t"))
    return each.select("session_id", F.col("t.iteration").alias("iteration"), (-F.col("t.value")).alias("objective"), F.col("t.gradient").alias("grad_norm"), "strategy", "success")


def sessions(trace: DataFrame, session: str = "session_id") -> DataFrame:
    """Per session: evaluations, first, last, best and worst objective, where the best was, improvement, mean gradient norm."""
    return trace.groupBy(session).agg(
        F.count(F.lit(1)).alias("evaluations"), F.min_by("objective", "iteration").alias("first"), F.max_by("objective", "iteration").alias("last"),
        F.min("objective").alias("best"), F.max("objective").alias("worst"), F.min_by("iteration", F.struct("objective", "iteration")).alias("best_at"),
        (F.min_by("objective", "iteration") - F.max_by("objective", "iteration")).alias("improvement"), F.avg("grad_norm").alias("mean_grad_norm"),
    )


def convergence_rate(trace: DataFrame, session: str = "session_id", last: int = 10) -> DataFrame:
    """Minus the slope of log(objective - least + 1e-10) over the last evaluations of each session."""
    w = Window.partitionBy(session).orderBy(F.desc("iteration"))
    tail = trace.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    least = F.min("objective").over(Window.partitionBy(session))
    tail = tail.withColumn("_y", F.ln(F.col("objective") - least + 1e-10))
    return tail.groupBy(session).agg((-F.regr_slope("_y", F.col("iteration").cast("double"))).alias("rate"), F.count(F.lit(1)).alias("points"))


def strategies(runs: DataFrame, value: str = "objective", by: str = "strategy") -> DataFrame:
    """Per strategy: runs, success rate, and the objective's mean, spread and least over successes."""
    good = F.when(F.col("success"), F.col(value))
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("sd"), F.min(good).alias("least"))


def efficiency(iterations: Column, seconds: Column, parameters: Column, success: Column) -> Column:
    """Score up to 100: less for many iterations and long runs, more for success."""
    score = F.when(iterations > 1000, 80.0).otherwise(100.0) * F.when(seconds > parameters, 0.5).otherwise(1.0) * F.when(success, 1.2).otherwise(0.3)
    return F.least(F.lit(100.0), score)


def executions(tasks: DataFrame, by: str | None = None) -> DataFrame:
    g = tasks.groupBy(by) if by else tasks.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("success").alias("successes"), F.sum("seconds").alias("total_s"), F.avg("seconds").alias("mean_s"),
        F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"),
        *([F.max("peak_mb").alias("peak_mb")] if "peak_mb" in tasks.columns else []),
    )


def error_types(errors: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent error types with their share of recoveries."""
    g = errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("recovered").cast("double")).alias("recovery_rate"))
    return g.orderBy(F.desc("n"), "error_type").limit(top)


def error_summary(errors: DataFrame) -> DataFrame:
    """(kind, value, n, recovery_rate): errors by severity and by category."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("severity", "category")])).alias("k")
    return errors.select(each, "recovered").groupBy("k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("recovered").cast("double")).alias("recovery_rate"))


def performance_gate(baseline: DataFrame, current: DataFrame, on: str, most: float = 2.0, least: float = 0.9) -> DataFrame:
    """(key, ratio, success_ratio, passed) from (key, seconds, success_rate): slower than ``most`` times the baseline, or successes under ``least`` of its, fail."""
    side = lambda df, s: df.select(on, F.col("seconds").alias(f"{s}_s"), F.col("success_rate").alias(f"{s}_r"))
    j = side(baseline, "a").join(side(current, "b"), on)
    j = j.select(on, F.try_divide(F.col("b_s"), F.col("a_s")).alias("ratio"), F.try_divide(F.col("b_r"), F.col("a_r")).alias("success_ratio"), "a_r", "b_r")
    return j.withColumn("passed", F.coalesce(F.col("ratio") <= most, F.lit(True)) & (F.col("b_r") >= least * F.col("a_r"))).drop("a_r", "b_r")


def likelihood_gate(baseline: DataFrame, current: DataFrame, on: str, tol: float = 1e-6) -> DataFrame:
    """(key, ll_diff, warning): log-likelihoods that moved by over ten tolerances."""
    side = lambda df, s: df.select(on, F.col("log_likelihood").alias(s))
    j = side(baseline, "a").join(side(current, "b"), on)
    return j.select(on, F.abs(F.col("b") - F.col("a")).alias("ll_diff")).withColumn("warning", F.col("ll_diff") > 10 * tol)


def regression_gate(baseline: DataFrame, current: DataFrame, on: str, value: str = "value", tol: float = 1e-6, rel: float = 1e-4) -> DataFrame:
    """Baseline and current values by key: differences and whether they pass."""
    j = baseline.select(on, F.col(value).alias("was")).join(current.select(on, F.col(value).alias("now")), on, "left")
    j = j.withColumns({"abs_diff": F.abs(F.col("now") - F.col("was")), "rel_diff": F.coalesce(F.try_divide(F.abs(F.col("now") - F.col("was")), F.abs("was")), F.lit(0.0))})
    return j.withColumn("passed", F.col("now").isNotNull() & F.coalesce((F.col("abs_diff") <= tol) | (F.col("rel_diff") <= rel), F.lit(False)))


def difficulty(parameter_ratio: Column, sparsity: Column, occasions: Column, parameters: Column) -> Column:
    """easy ... very difficult, from parameters per individual, share of zeros, occasions and model size."""
    score = F.when(parameter_ratio > 0.1, 3).when(parameter_ratio > 0.05, 2).when(parameter_ratio > 0.02, 1).otherwise(0)
    score = score + F.when(sparsity > 0.9, 2).when(sparsity > 0.8, 1).otherwise(0) + (occasions > 5).cast("int") + (parameters > 2 * occasions).cast("int")
    return F.when(score >= 6, "very_difficult").when(score >= 4, "difficult").when(score >= 2, "moderate").otherwise("easy")
