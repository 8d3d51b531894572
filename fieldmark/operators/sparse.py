"""Population estimates from sparse detections: one aggregate over individuals, then expressions on one row."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.fit import Penalty, Spec, fit, predicted
from fieldmark.sources.histories import CaptureFrame


def counts(df: DataFrame, occasions: int, x: str = "x") -> DataFrame:
    """One row: n, never, once, twice, multiple, captures, occasions."""
    c = F.col(x)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c == 0).alias("never"), F.count_if(c == 1).alias("once"), F.count_if(c == 2).alias("twice"),
        F.count_if(c > 1).alias("multiple"), F.sum(c).alias("captures"), F.lit(occasions).alias("occasions"),
    )


def patterns(df: DataFrame, ch: str = "ch") -> DataFrame:
    """Histories with their frequencies."""
    return df.groupBy(ch).agg(F.count(F.lit(1)).alias("n"))


def sparsity(df: DataFrame, occasions: int, ch: str = "ch") -> DataFrame:
    """Detection rate, coverage, sparse patterns and severity."""
    p = patterns(df, ch).agg(F.count(F.lit(1)).alias("patterns"), F.min("n").alias("least_count"), (100.0 * F.count_if(F.col("n") <= 3) / F.count(F.lit(1))).alias("sparse_pct"))
    one = counts(df, occasions).crossJoin(F.broadcast(p))  # one row each
    one = one.withColumns({
        "detection_rate": F.try_divide(F.col("captures").cast("double"), F.col("n") * F.col("occasions")),
        "coverage": F.coalesce(F.try_divide(F.col("multiple").cast("double"), (F.col("n") - F.col("never")).cast("double")), F.lit(0.0)),
    })
    cover, pct = F.col("coverage"), F.col("sparse_pct")
    grade = lambda c, s: (cover < c) | (pct > s)
    severity = F.when(grade(0.30, 50), "EXTREME").when(grade(0.55, 25), "HIGH").when(grade(0.70, 10), "MODERATE").otherwise("LOW")
    return one.withColumn("severity", severity)


def sparsity_by_share(df: DataFrame, occasions: int, ch: str = "ch") -> DataFrame:
    """The variant whose rare patterns are those up to max(5, 1 % of n), with a risk label."""
    n = counts(df, occasions)
    p = patterns(df, ch).select(F.col("n").alias("k"))
    one = p.crossJoin(F.broadcast(n)).groupBy(*n.columns).agg(F.count_if(F.col("k") <= F.greatest(F.lit(5.0), 0.01 * F.col("n"))).alias("rare"), F.count(F.lit(1)).alias("patterns"))
    cover = F.coalesce(F.try_divide(F.col("multiple").cast("double"), (F.col("n") - F.col("never")).cast("double")), F.lit(0.0))
    one = one.withColumns({"coverage": cover, "rare_pct": 100.0 * F.col("rare") / F.col("patterns").cast("double")})
    grade = lambda s, c: (F.col("rare_pct") > s) | (F.col("coverage") < c)
    return one.withColumn("risk", F.when(grade(30, 0.55), "HIGH").when(grade(15, 0.70), "MODERATE").otherwise("LOW"))


def coverage_estimate(one: DataFrame) -> DataFrame:
    """Sample-coverage estimate of population size, from a row of ``counts``."""
    n1, n2, seen = (F.col(c).cast("double") for c in ("once", "twice", "seen"))
    one = one.withColumn("seen", F.col("n") - F.col("never"))
    raw = F.when(n2 > 0, 1.0 - F.try_divide(n1, 2.0 * n2) * F.try_divide(n1, seen)).otherwise(1.0 - F.coalesce(F.try_divide(n1, seen), F.lit(0.0)))
    one = one.withColumn("c_hat", F.least(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    extra = F.when(n2 > 0, F.try_divide(n1 * n1, 2.0 * n2)).otherwise(n1 * (n1 - 1.0) / 2.0)
    wide = F.when(n1 > 0, seen + n1 * n1 / (2.0 * F.greatest(n2, F.lit(1.0)))).otherwise(2.0 * seen)
    good = F.col("c_hat") >= 0.55
    one = one.withColumn("estimate", F.when(good, seen + extra).otherwise((seen + wide) / 2.0))
    var = F.when(good & (n2 > 0), n1 * (n1 / 4.0 + F.try_divide(n1 * n1, 4.0 * n2) + F.try_divide(F.power(n1, F.lit(3.0)), 4.0 * n2 * n2)))
    one = one.withColumn("variance", var)
    half = 1.96 * F.sqrt("variance")
    return one.withColumns({
        "ci_lower": F.when(F.col("variance").isNotNull(), F.greatest(seen, F.col("estimate") - half)).otherwise(F.greatest(seen, 0.7 * F.col("estimate"))),
        "ci_upper": F.when(F.col("variance").isNotNull(), F.col("estimate") + half).otherwise(1.5 * F.col("estimate")),
        "reliability": F.when(F.col("c_hat") >= 0.75, "high").when(good, "moderate").otherwise("low"),
    })


def bounds(one: DataFrame) -> DataFrame:
    """Conservative bounds: what was seen, and the least of two upper bounds and ten times n."""
    n, multi, det, t = F.col("n").cast("double"), F.col("multiple").cast("double"), F.col("captures").cast("double"), F.col("occasions").cast("double")
    first = F.when(multi > 0, n / F.greatest(F.lit(0.1), multi / n)).otherwise(3.0 * n)
    second = F.when(det > 0, n / F.greatest(F.lit(0.05), det / n / t)).otherwise(5.0 * n)
    one = one.withColumns({"lower": (F.col("n") - F.col("never")).cast("double"), "upper": F.least(first, second, 10.0 * n)})
    return one.withColumn("point", F.sqrt(F.col("lower") * F.col("upper")))


def regularised(frame: CaptureFrame, spec: Spec = Spec(), strength: float = 0.1, by: str = "coefficients") -> DataFrame:
    """One row from a fit with a ridge on all coefficients, intercepts too: seen, detection, regularised, ci_lower, ci_upper, reliability.

    The population is what was seen over ``detection``, 0.1 at least.  By "coefficients" that is the mean of the exponentials of
    the first coefficients, one an occasion at most; by "detection" it is the share that the fit expects to be seen at all when present
    throughout, averaged over those seen.  Where the fit fails, 1.5 times what was seen stands in, with wider bounds.
    """
    row = fit(frame, spec, penalty=Penalty(ridge=strength, intercepts=True))
    seen = F.count_if(F.col("x") > 0).cast("double")
    if not row["converged"]:
        one = frame.df.agg(seen.alias("seen")).select("seen", F.lit(None).cast("double").alias("detection"), (1.5 * F.col("seen")).alias("regularised"))
        low, high, label = 0.6, 2.0, "low"
    else:
        if by == "coefficients":
            found = [q["estimate"] for q in row["params"]][: frame.occasions]
            one = frame.df.agg(seen.alias("seen")).withColumn("detection", F.lit(sum(math.exp(v) for v in found) / len(found)))
        else:
            ever = 1.0 - F.power(1.0 - F.col("p"), F.lit(float(frame.occasions)))
            one = predicted(frame, row).agg(seen.alias("seen"), F.avg(F.when(F.col("x") > 0, ever)).alias("detection"))
        one = one.withColumn("regularised", F.col("seen") / F.greatest(F.lit(0.1), F.col("detection")))
        low, high, label = 0.8, 1.3, "moderate"
    return one.withColumns({"ci_lower": low * F.col("regularised"), "ci_upper": high * F.col("regularised"), "reliability": F.lit(label)})


def consensus(one: DataFrame, regularised: str | None = None) -> DataFrame:
    """The coverage estimate, and what else ``severity`` calls for: the bounds' point where it is extreme, the ridge fit's estimate
    (column ``regularised``, where not null) where it is high or moderate.  ``consensus`` is the mean of the estimates there are.
    """
    one = bounds(coverage_estimate(one))
    other = F.when(F.col("severity") == "EXTREME", F.col("point"))
    if regularised:
        other = other.when(F.col("severity").isin("HIGH", "MODERATE"), F.col(regularised))
    one = one.withColumn("other", other)
    both = F.col("other").isNotNull()
    return one.withColumns({
        "consensus": F.when(both, (F.col("estimate") + F.col("other")) / 2.0).otherwise(F.col("estimate")),
        "method": F.when(both, "multi_method_average").otherwise("sample_coverage"),
    }).drop("other")


def estimated(frame: CaptureFrame, spec: Spec | None = None, strength: float = 0.1) -> DataFrame:
    """All of it for a data set: sparsity, coverage estimate, bounds, the ridge fit where ``spec`` is given and severity calls for it, consensus."""
    one = sparsity(frame.df, frame.occasions)
    if spec is not None and one.first()["severity"] in ("HIGH", "MODERATE"):
        return consensus(one.crossJoin(F.broadcast(regularised(frame, spec, strength).select("regularised"))), "regularised")  # one row each
    return consensus(one.withColumn("regularised", F.lit(None).cast("double")))
