"""Agreement and equivalence of two sets of estimates.

Pairs are tables with a row a parameter (param, est_a, se_a, est_b, se_b, and a model where there
are several); t quantiles come from the driver as literals, t probabilities are columns.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.dist import t_quantile
from fieldmark.functions.tails import t_sf
from fieldmark.operators.many import poisson, uniforms
from fieldmark.operators.quantile import median
from fieldmark.operators.ranks import rank_counts

T1_95 = 12.706204736432095  # t quantile with one degree of freedom, 97.5 %


def paired(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Estimates of both sides by key: (keys, est_a, se_a, est_b, se_b)."""
    side = lambda df, s: df.select(*on, F.col("estimate").alias(f"est_{s}"), F.col("se").alias(f"se_{s}"))
    return side(a, "a").join(side(b, "b"), on)


def unmatched(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    only = lambda x, y, s: x.select(*on).join(y.select(*on), on, "left_anti").withColumn("side", F.lit(s))
    return only(a, b, "a").unionByName(only(b, a, "b"))


def parameter_type(name: Column) -> Column:
    """phi, p, f by the part before the first separator."""
    head = F.lower(F.regexp_extract(name, r"^([A-Za-z]+)", 1))
    return F.when(head.isin("phi", "p", "f"), head).otherwise("other")


def correlation(a: str, b: str) -> Column:
    """Pearson's r as an aggregate; null where a column is constant."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def equivalence(pairs: DataFrame, margin: float = 0.05, alpha: float = 0.05, with_p: bool = False) -> DataFrame:
    """Two one-sided t tests: bounds of margin * max(|a|, |b|, 1); ``with_p`` adds p and a status."""
    a, b, s1, s2 = F.col("est_a"), F.col("est_b"), F.col("se_a"), F.col("se_b")
    bound = F.lit(margin) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    out = pairs.withColumns({"diff": a - b, "bound": bound, "se_diff": F.sqrt(s1 * s1 + s2 * s2)})
    df = F.greatest(F.lit(1), F.coalesce(F.try_divide(F.power(s1 * s1 + s2 * s2, F.lit(2.0)), F.power(s1, F.lit(4.0)) + F.power(s2, F.lit(4.0))), F.lit(1.0)).cast("int"))
    out = out.withColumns({
        "t_lower": F.try_divide(F.col("diff") + F.col("bound"), F.col("se_diff")), "t_upper": F.try_divide(F.col("bound") - F.col("diff"), F.col("se_diff")),
        "df": df, "effect": F.try_divide(F.col("diff"), F.col("se_diff")),
    })
    if not with_p:
        return out
    d = F.col("df").cast("double")
    out = out.withColumn("p", F.greatest(t_sf(F.col("t_lower"), d), t_sf(F.col("t_upper"), d)))
    return out.withColumn("status", F.when(F.col("p").isNull(), "INCONCLUSIVE").when(F.col("p") < alpha, "EQUIVALENT").otherwise("NOT_EQUIVALENT"))


def simple_equivalence(pairs: DataFrame, margin: float = 0.05) -> DataFrame:
    rel = F.coalesce(F.try_divide(F.abs(F.col("est_a") - F.col("est_b")), F.abs(F.col("est_b"))), F.abs(F.col("est_a") - F.col("est_b")))
    return pairs.withColumn("rel_diff", rel).withColumn("equivalent", rel <= margin)


def interval_overlap(pairs: DataFrame, t: float = T1_95) -> DataFrame:
    """Overlap of both intervals over their average width, the gap between them, and a status."""
    lo = lambda s: F.col(f"est_{s}") - t * F.col(f"se_{s}")
    hi = lambda s: F.col(f"est_{s}") + t * F.col(f"se_{s}")
    start, end = F.greatest(lo("a"), lo("b")), F.least(hi("a"), hi("b"))
    width = (hi("a") - lo("a") + hi("b") - lo("b")) / 2.0
    out = pairs.withColumns({"overlap": F.when(end >= start, F.coalesce(F.try_divide(end - start, width), F.lit(0.0))).otherwise(0.0), "gap": F.greatest(start - end, F.lit(0.0))})
    return out.withColumn("status", F.when(end < start, "NOT_EQUIVALENT").when(F.col("overlap") > 0.5, "EQUIVALENT").otherwise("INCONCLUSIVE"))


def effect_label(d: Column) -> Column:
    d = F.abs(d)
    return F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")


def compared(pairs: DataFrame, absolute: float = 1e-3, relative_pct: float = 5.0, z: float = 1.959963984540054) -> DataFrame:
    """Per parameter: differences, interval overlap, tolerances and a status by relative difference."""
    a, b, s1, s2 = F.col("est_a"), F.col("est_b"), F.col("se_a"), F.col("se_b")
    out = interval_overlap(pairs, z).drop("gap", "status").withColumnRenamed("overlap", "overlap_prop")
    diff = F.abs(a - b)
    rel = F.when(F.abs(b) > 1e-10, 100.0 * F.try_divide(diff, F.abs(b))).when(diff > 1e-10, F.lit(float("inf"))).otherwise(0.0)
    out = out.withColumns({
        "param_type": parameter_type(F.col("param")), "abs_diff": diff, "rel_pct": rel,
        "std_diff": F.when((s1 > 0) & (s2 > 0), F.try_divide(diff, F.sqrt((s1 * s1 + s2 * s2) / 2.0))).otherwise(0.0),
        "ci_overlap": (F.least(a + z * s1, b + z * s2) >= F.greatest(a - z * s1, b - z * s2)),
        "within_abs": diff <= absolute, "within_rel": rel <= relative_pct,
    })
    status = F.when(F.col("rel_pct") < 0.1, "EXCELLENT").when(F.col("rel_pct") < 1, "GOOD").when(F.col("rel_pct") < 5, "ACCEPTABLE").when(F.col("rel_pct") < 20, "POOR").otherwise("FAILED")
    return out.withColumn("status", status)


def comparison_summary(cmp: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means, medians and maxima of differences, and shares of each status."""
    share = lambda s: F.avg((F.col("status") == s).cast("double")).alias(s.lower())
    passed = F.avg(F.col("status").isin("EXCELLENT", "GOOD", "ACCEPTABLE").cast("double")).alias("pass_rate")
    g = cmp.groupBy(*by) if by else cmp.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_diff").alias("mean_abs"), F.median("abs_diff").alias("median_abs"), F.max("abs_diff").alias("max_abs"),
        F.avg("rel_pct").alias("mean_rel"), F.median("rel_pct").alias("median_rel"), F.max("rel_pct").alias("max_rel"),
        F.avg(F.col("ci_overlap").cast("double")).alias("overlap_rate"), passed, *[share(s) for s in ("EXCELLENT", "GOOD", "ACCEPTABLE", "POOR", "FAILED")],
    )


def critical(cmp: DataFrame) -> DataFrame:
    """The intercepts."""
    return cmp.where(F.lower("param").contains("intercept"))


def models_compared(models: DataFrame, cmp: DataFrame) -> DataFrame:
    """Per model from (model, aic_a, aic_b, ll_a, ll_b) and parameter comparisons with model: status of the whole."""
    ok = F.col("status").isin("EXCELLENT", "GOOD", "ACCEPTABLE").cast("double")
    is_critical = F.lower("param").contains("intercept")
    rates = cmp.groupBy("model").agg(F.avg(ok).alias("pass_rate"), F.coalesce(F.avg(F.when(is_critical, ok)), F.lit(1.0)).alias("critical_rate"))
    out = models.join(rates, "model").withColumns({
        "aic_diff": F.abs(F.col("aic_a") - F.col("aic_b")),
        "ll_pct": F.coalesce(100.0 * F.try_divide(F.abs(F.col("ll_a") - F.col("ll_b")), F.abs("ll_b")), F.lit(0.0)),
    })
    aic_ok, ll_ok, good, crit = F.col("aic_diff") < 2, F.col("ll_pct") < 1, F.col("pass_rate") >= 0.8, F.col("critical_rate") >= 0.9
    status = F.when(aic_ok & ll_ok & good & crit, "EXCELLENT").when((aic_ok | ll_ok) & good, "GOOD").when(good & crit, "ACCEPTABLE").when(good | crit, "POOR").otherwise("FAILED")
    return out.withColumn("status", status)


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks with ties averaged (over tables with a row a model or parameter)."""
    low = F.rank().over(Window.orderBy(value))
    return df.withColumn(out, low + (F.count(F.lit(1)).over(Window.partitionBy(value)) - 1) / F.lit(2.0))


def rank_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pair counts, Kendall's tau-a and tau-b, Spearman's rho, share of equal ranks, and a class.

    From inversion counts (:mod:`fieldmark.operators.ranks`), so tables may be large; rows with a null or NaN take no part.
    """
    k = rank_counts(df, F.col(a), F.col(b))
    diff = float(k["concordant"] - k["discordant"])
    free = float(k["pairs"] - k["ties_a"]) * float(k["pairs"] - k["ties_b"])
    tau_a, tau_b = diff / k["pairs"] if k["pairs"] else None, diff / free**0.5 if free > 0 else None
    label = "high" if (tau_b or 0) >= 0.8 else "moderate" if (tau_b or 0) >= 0.6 else "low"
    row = tuple(k[c] for c in ("pairs", "concordant", "discordant", "ties_a", "ties_b")) + (tau_a, tau_b, k["rho"], k["exact"], label)
    counts = "pairs {0}, concordant {0}, discordant {0}, ties_a {0}, ties_b {0}".format("long" if k["pairs"] < 1 << 63 else "double")
    row = row if k["pairs"] < 1 << 63 else tuple(float(v) if i < 5 else v for i, v in enumerate(row))
    return df.sparkSession.createDataFrame([row], f"{counts}, tau_a double, tau_b double, rho double, exact double, agreement string")


def concordance(pairs: DataFrame, t: float | None = None) -> DataFrame:
    """One row: correlation, Lin's concordance, errors, bias, limits of agreement, proportional bias, robust parts, category."""
    ok = pairs.where("est_a is not null and est_b is not null and not isnan(est_a) and not isnan(est_b)")
    rows = ok.withColumns({"d": F.col("est_a") - F.col("est_b"), "m": (F.col("est_a") + F.col("est_b")) / 2.0})
    if t is None:
        n = rows.count()
        if n < 3:
            raise ValueError("Need at least 3 pairs")
        t = t_quantile(0.975, n - 1)
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), correlation("est_a", "est_b").alias("r"),
        F.try_divide(2.0 * F.covar_samp("est_a", "est_b"), F.var_samp("est_a") + F.var_samp("est_b") + F.power(F.avg("est_a") - F.avg("est_b"), F.lit(2.0))).alias("ccc"),
        F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg("d").alias("bias"), F.stddev_samp("d").alias("sd"),
        F.abs(F.coalesce(correlation("m", "d"), F.lit(0.0))).alias("proportional_bias"),
    )
    middle = median(rows, F.col("d"))
    mad = None if middle is None else median(rows, F.abs(F.col("d") - middle))
    one = one.withColumns({"median_diff": F.lit(middle).cast("double"), "mad": F.lit(mad).cast("double")})
    one = one.withColumns({"loa_lower": F.col("bias") - t * F.col("sd"), "loa_upper": F.col("bias") + t * F.col("sd"), "t_bias": F.try_divide(F.col("bias"), F.col("sd") / F.sqrt("n"))})
    c = F.col("ccc")
    one = one.withColumn("category", F.when(c >= 0.99, "excellent").when(c >= 0.95, "substantial").when(c >= 0.90, "moderate").when(c >= 0.75, "fair").otherwise("poor"))
    k = rows.crossJoin(F.broadcast(one.select(F.col("median_diff").alias("md"), "mad", "loa_lower", "loa_upper")))  # one row
    score = F.abs(F.try_divide(0.6745 * (F.col("d") - F.col("md")), F.col("mad")))
    k = k.agg(F.count_if(score > 3.5).alias("outliers"), (100.0 * F.avg(((F.col("d") >= F.col("loa_lower")) & (F.col("d") <= F.col("loa_upper"))).cast("double"))).alias("within_pct"))
    return one.crossJoin(F.broadcast(k))


def outliers(df: DataFrame, value: str, cut: float = 3.5) -> DataFrame:
    """``outlier`` by the modified z-score, from an exact median and median deviation."""
    middle = median(df, F.col(value))
    mad = None if middle is None else median(df, F.abs(F.col(value) - middle))
    score = F.abs(F.try_divide(0.6745 * (F.col(value) - F.lit(middle)), F.lit(mad).cast("double")))
    return df.withColumn("outlier", F.coalesce(score > cut, F.lit(False)))


def bootstrap_difference(pairs: DataFrame, statistic=None, replicates: int = 1000, seed: int = 42, chunk: int = 50, nested: int = 0) -> DataFrame:
    """(rep, value) of a statistic of both columns over resampled pairs (a table with a row a parameter).

    Replicates are shared out in chunks; the pairs, a table of bounded size, go to each.  With ``nested``, column ``se``
    has the statistic's standard error in each replicate, from as many resamples of that replicate.
    """
    stat = statistic or (lambda x, y: float(np.mean(x) - np.mean(y)))
    n = -(-replicates // chunk)
    ids = pairs.sparkSession.range(n).select(F.col("id").cast("int").alias("part"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["est_a", "est_b"])
        x, y = pdf["est_a"].to_numpy(), pdf["est_b"].to_numpy()
        rng = np.random.default_rng([seed, int(key[0])])
        inner = np.random.default_rng([seed, int(key[0]), 1])
        reps = range(int(key[0]) * chunk, min(replicates, (int(key[0]) + 1) * chunk))
        out = []
        for r in reps:
            pick = rng.integers(0, len(x), len(x))
            row = (r, float(stat(x[pick], y[pick])))
            if nested:
                again = [pick[inner.integers(0, len(x), len(x))] for _ in range(nested)]
                row += (float(np.std([stat(x[i], y[i]) for i in again], ddof=1)),)
            out.append(row)
        return pd.DataFrame(out, columns=["rep", "value", "se"][: 2 + bool(nested)])

    return pairs.select("est_a", "est_b").crossJoin(F.broadcast(ids)).groupBy("part").applyInPandas(run, "rep int, value double" + (", se double" if nested else ""))


def studentised_interval(reps: DataFrame, observed: float, level: float = 0.95) -> tuple[float, float]:
    """From replicates with standard errors (rep, value, se): quantiles of (value - observed) / se, turned round."""
    t = F.try_divide(F.col("value") - observed, F.col("se"))
    a = (1 - level) / 2
    row = reps.agg(F.percentile(t, F.lit(a)), F.percentile(t, F.lit(1 - a)), F.stddev_samp("value")).first()
    return observed - row[1] * row[2], observed - row[0] * row[2]


def mean_replicates(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, value, se) of the mean difference over resampled pairs, for tables of any size.

    Equal differences are counted once; each has a Poisson weight in every replicate, and one aggregate sums
    all replicates.  The mean's standard error follows from a replicate's own sums.
    """
    d = pairs.select((F.col("est_a") - F.col("est_b")).alias("d")).where("d is not null")
    rows = d.groupBy("d").agg(F.count(F.lit(1)).alias("n")).withColumn("draw", F.xxhash64(F.lit(seed), "d"))

    def run(batches):
        part = np.zeros((replicates, 3))
        for pdf in batches:
            v, n, key = pdf["d"].to_numpy(), pdf["n"].to_numpy(), pdf["draw"].to_numpy()
            for r in range(replicates):
                w = poisson(n, uniforms(key, r))
                part[r] += w.sum(), w @ v, w @ (v * v)
        yield pd.DataFrame({"rep": np.arange(replicates, dtype=np.int32), "w": part[:, 0], "s": part[:, 1], "ss": part[:, 2]})

    out = rows.mapInPandas(run, "rep int, w double, s double, ss double").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("w", "s", "ss")])
    mean = F.try_divide(F.col("s"), F.col("w"))
    return out.select("rep", mean.alias("value"), F.sqrt(F.greatest(F.try_divide(F.col("ss"), F.col("w")) - mean * mean, F.lit(0.0)) / F.col("w")).alias("se"))


def bootstrap_intervals(reps: DataFrame, observed: float, level: float = 0.95) -> DataFrame:
    """Percentile, basic and t intervals of a replicate table, with a stability label."""
    a = (1 - level) / 2
    one = reps.agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("se"),
        F.percentile("value", F.lit(a)).alias("percentile_lower"), F.percentile("value", F.lit(1 - a)).alias("percentile_upper"),
    )
    t = t_quantile(1 - a, max(1, 30))
    cv = F.when(F.lit(observed) != 0, F.col("se") / abs(observed or 1.0)).otherwise(F.lit(float("inf")))
    label = F.when(F.col("replicates") < 100, "insufficient_samples").when(F.col("se") == 0, "no_variation").when(cv < 0.01, "very_stable").when(cv < 0.05, "stable").when(cv < 0.2, "moderate").otherwise("unstable")
    return one.withColumns({
        "bias": F.col("mean") - observed, "basic_lower": 2 * observed - F.col("percentile_upper"), "basic_upper": 2 * observed - F.col("percentile_lower"),
        "t_lower": observed - t * F.col("se"), "t_upper": observed + t * F.col("se"), "stability": label,
    })


def jackknife(pairs: DataFrame) -> DataFrame:
    """One row on the mean difference with each pair left out in turn: n, observed, jackknife standard error and acceleration.

    In closed form from the first three moments: no pair is left out in fact, and one aggregate serves any number.
    """
    d = F.col("est_a") - F.col("est_b")
    one = pairs.agg(F.count(d).alias("n"), F.avg(d).alias("observed"), F.stddev_samp(d).alias("sd"), F.skewness(d).alias("skew"))
    root = F.sqrt(F.col("n").cast("double"))
    return one.select("n", "observed", (F.col("sd") / root).alias("se"), (F.col("skew") / (6.0 * root)).alias("acceleration"))


def bca_interval(reps: DataFrame, observed: float, acceleration: float, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval: quantiles of the replicates at shares moved by bias and acceleration."""
    from fieldmark.functions.dist import normal_cdf, normal_quantile

    row = reps.agg(F.avg((F.col("value") < observed).cast("double")), F.count(F.lit(1))).first()
    z0 = normal_quantile(min(max(row[0], 0.5 / row[1]), 1 - 0.5 / row[1]))
    at = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal_quantile(q)
        at.append(normal_cdf(z0 + z / (1 - acceleration * z)))
    return tuple(reps.agg(*[F.percentile("value", F.lit(q)) for q in at]).first())


# --- quality gate --------------------------------------------------------------------------------

# fixed values: metric, excellent / good / acceptable thresholds, weight, component
METRICS = {
    "parameter_accuracy": (0.99, 0.95, 0.90, 2.0, "parameter"), "statistical_power": (0.95, 0.90, 0.80, 1.0, "parameter"),
    "model_concordance": (0.95, 0.85, 0.80, 1.5, "model"), "convergence_reliability": (0.98, 0.95, 0.90, 1.8, "model"),
    "system_stability": (0.98, 0.95, 0.90, 1.0, "system"), "performance_efficiency": (0.95, 0.85, 0.75, 0.5, "system"),
}
COMPONENTS = {"parameter": 0.5, "model": 0.3, "system": 0.2}


def quality_metrics(cmp: DataFrame) -> DataFrame:
    """One row: accuracy and equivalence rates, mean and maximal relative difference over those above 0."""
    finite = F.when((F.col("rel_pct") > 0) & (F.col("rel_pct") < float("inf")), F.col("rel_pct"))
    return cmp.agg(
        F.avg(F.col("status").isin("EXCELLENT", "GOOD", "ACCEPTABLE").cast("double")).alias("accuracy_rate"),
        F.avg(F.col("ci_overlap").cast("double")).alias("equivalence_rate"), F.coalesce(F.avg(finite), F.lit(0.0)).alias("mean_rel"), F.coalesce(F.max(finite), F.lit(0.0)).alias("max_rel"),
    )


def gate(metrics: DataFrame, warnings: int = 0) -> DataFrame:
    """From rows (metric, value): component scores, the weighted score, risk and the decision, in one row."""
    table = F.create_map(*[x for k, (e, g, a, w, c) in METRICS.items() for x in (F.lit(k), F.struct(*[F.lit(v) for v in (e, g, a, w)], F.lit(c)))])
    m = metrics.withColumn("t", F.element_at(table, F.col("metric")))
    m = m.select("metric", "value", F.col("t.col4").alias("w"), F.col("t.col5").alias("component"), F.when(F.col("value") >= F.col("t.col1"), "excellent").when(F.col("value") >= F.col("t.col2"), "good").when(F.col("value") >= F.col("t.col3"), "acceptable").otherwise("poor").alias("level"))
    c = m.groupBy("component").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("score"), F.max((F.col("level") == "poor").cast("int")).alias("poor"))
    share = F.element_at(F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv]), F.col("component"))
    one = c.agg(
        (F.sum(F.col("score") * share) / F.sum(share)).alias("score"), F.sum("poor").alias("poor_components"),
        F.max(F.when(F.col("component") == "parameter", F.col("poor"))).alias("poor_parameter"), F.max(F.when(F.col("component") == "model", F.col("poor"))).alias("poor_model"),
    )
    risk = F.when(F.col("poor_components") >= 2, "CRITICAL").when(F.col("poor_components") == 1, "HIGH").when(F.col("score") < 0.9, "MODERATE").otherwise("LOW")
    one = one.withColumn("risk", risk)
    review = F.col("risk").isin("CRITICAL", "HIGH") | (F.coalesce("poor_parameter", F.lit(0)) == 1) | (F.coalesce("poor_model", F.lit(0)) == 1)
    decision = F.when(review, "MANUAL_REVIEW").when((F.col("score") >= 0.9) & F.lit(warnings == 0), "APPROVED").when(F.col("score") >= 0.75, "APPROVED_WITH_WARNINGS").otherwise("MANUAL_REVIEW")
    return one.withColumn("decision", decision)


def simple_gate(cmp: DataFrame, converged: Column | None = None) -> DataFrame:
    """The shorter gate: rejected on a failed intercept, approved by pass rate."""
    ok = F.col("status").isin("EXCELLENT", "GOOD", "ACCEPTABLE")
    one = cmp.agg(F.avg(ok.cast("double")).alias("pass_rate"), F.count_if(~ok & F.lower("param").contains("intercept")).alias("critical_failures"))
    return one.withColumn("decision", F.when(F.col("critical_failures") > 0, "REJECTED").when(F.col("pass_rate") >= 0.9, "APPROVED").when(F.col("pass_rate") >= 0.75, "APPROVED_WITH_WARNINGS").otherwise("MANUAL_REVIEW"))


def conclusion(rate: Column) -> Column:
    """What a pass rate says of a whole validation."""
    return F.when(rate >= 0.9, "excellent").when(rate >= 0.8, "good").when(rate >= 0.7, "acceptable").otherwise("poor")


def fold_stability(rows: DataFrame, by: list[str] = ["param"]) -> DataFrame:  # noqa: B006
    """Mean and spread of differences over repeats and folds, coefficient of variation and a label."""
    cv = F.try_divide(F.stddev_samp("value"), F.abs(F.avg("value")))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), cv.alias("cv"))
    return out.withColumn("stability", F.when(F.col("cv") < 0.01, "very_stable").when(F.col("cv") < 0.05, "stable").when(F.col("cv") < 0.2, "moderate").otherwise("unstable"))


def fold_metrics(rows: DataFrame, by: list[str] = ["param"]) -> DataFrame:  # noqa: B006
    """Over (repeat, fold, keys, abs_diff, rel_pct, converged): means and spreads of both differences, share converged, stability."""
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_diff").alias("mean_abs"), F.stddev_pop("abs_diff").alias("sd_abs"), F.avg("rel_pct").alias("mean_rel"),
        F.stddev_pop("rel_pct").alias("sd_rel"), F.avg(F.col("converged").cast("double")).alias("convergence_rate"),
    )
    cv = F.try_divide(F.col("sd_rel"), F.abs("mean_rel"))
    return out.withColumn("stability", F.when(cv < 0.01, "very_stable").when(cv < 0.05, "stable").when(cv < 0.2, "moderate").otherwise("unstable"))


def fold_likelihoods(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Over (val_ll, val_n, train_ll, train_n) a fold: mean and spread per individual, their ratio, and how consistent folds are."""
    each, own = F.try_divide(F.col("val_ll"), F.col("val_n")), F.try_divide(F.col("train_ll"), F.col("train_n"))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.avg(each).alias("mean_ll"), F.stddev_pop(each).alias("sd_ll"), F.avg(own).alias("train_mean_ll"))
    out = out.withColumn("consistency", F.try_divide(F.col("sd_ll"), F.abs("mean_ll")))
    return out.withColumn("label", F.when(F.col("consistency") < 0.05, "consistent").when(F.col("consistency") < 0.15, "moderate").otherwise("inconsistent"))


def convergence_agreement(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """One row over two tables of fits (keys, converged): how often both, one or neither converged, and the share that agree."""
    j = a.select(*on, F.col("converged").alias("ca")).join(b.select(*on, F.col("converged").alias("cb")), on)
    return j.agg(
        F.count(F.lit(1)).alias("models"), F.count_if(F.col("ca") & F.col("cb")).alias("both"), F.count_if(F.col("ca") != F.col("cb")).alias("one"),
        F.count_if(~F.col("ca") & ~F.col("cb")).alias("neither"), F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("agreement"),
    )


def categories(df: DataFrame, column: str) -> DataFrame:
    """Distribution of a category: counts and shares."""
    g = df.groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))  # a row a category


def stacked(tables: dict[str, DataFrame], label: str = "dataset") -> DataFrame:
    """Results of several data sets under each other, with the data set's name first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(F.lit(k).alias(label), "*") for k, df in tables.items()])


def publication_summary(cmp: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Rows (section, metric, value, note): overall, by type, critical parameters, models, and the conclusion."""
    def long(df: DataFrame, section: Column) -> DataFrame:
        cols = [c for c, t in df.dtypes if t in ("double", "bigint", "int")]
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("m")
        return df.select(section.alias("section"), each).select("section", "m.*", F.lit(None).cast("string").alias("note"))

    whole = comparison_summary(cmp)
    parts = [long(whole, F.lit("overall")), long(comparison_summary(cmp, ["param_type"]), F.concat(F.lit("type: "), F.col("param_type"))), long(comparison_summary(critical(cmp)), F.lit("critical"))]
    if models is not None:
        ok = F.col("status").isin("EXCELLENT", "GOOD", "ACCEPTABLE").cast("double")
        parts.append(long(models.agg(F.count(F.lit(1)).alias("n"), F.avg(ok).alias("pass_rate"), F.avg("aic_diff").alias("mean_aic_diff")), F.lit("models")))
    end = whole.select(F.lit("conclusion").alias("section"), F.lit("pass_rate").alias("metric"), F.col("pass_rate").alias("value"), conclusion(F.col("pass_rate")).alias("note"))
    return reduce(DataFrame.unionByName, [*parts, end])


def difference_intervals(pairs: DataFrame, replicates: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile, basic, t, studentised and bias-corrected accelerated intervals of the mean difference, in one row."""
    one = jackknife(pairs).first()
    observed = one["observed"]
    reps = mean_replicates(pairs, replicates, seed)
    reps = pairs.sparkSession.createDataFrame(reps.collect(), reps.schema)  # a row a replicate, from one aggregate
    low, high = bca_interval(reps, observed, one["acceleration"] or 0.0, level)
    start, end = studentised_interval(reps, observed, level)
    more = {"observed": observed, "bca_lower": low, "bca_upper": high, "studentised_lower": start, "studentised_upper": end}
    return bootstrap_intervals(reps.select("rep", "value"), observed, level).withColumns({k: F.lit(v) for k, v in more.items()})
