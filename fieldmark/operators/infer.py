"""Information criteria, goodness of fit, residuals and growth-rate summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import links
from fieldmark.functions.tails import chi2_sf
from fieldmark.operators.quantile import summary

Z95 = 1.959963984540054
MOST_MODELS = 10_000


def chi2_p(stat: Column, df: Column) -> Column:
    """Upper tail of chi-square."""
    return chi2_sf(stat, df)


def with_criteria(df: DataFrame, ll: str = "log_likelihood", k: str = "n_parameters", n: str = "n", c_hat: float = 1.0) -> DataFrame:
    """aic, aicc (infinite when n <= k + 1), bic, deviance, and qaic, qaicc (whole criteria over c_hat above 1)."""
    L, K, N = F.col(ll), F.col(k).cast("double"), F.col(n).cast("double")
    out = df.withColumns({
        "aic": 2.0 * K - 2.0 * L,
        "deviance": -2.0 * L,
        "bic": K * F.ln(F.greatest(N, F.lit(1.0))) - 2.0 * L,
        "aicc": F.when(N > K + 1, 2.0 * K - 2.0 * L + F.try_divide(2.0 * K * (K + 1), N - K - 1)).otherwise(F.lit(float("inf"))),
    })
    c = max(c_hat, 1.0)
    return out.withColumns({"qaic": F.col("aic") / c, "qaicc": F.col("aicc") / c})


def wald(df: DataFrame, estimate: str = "estimate", se: str = "se", z: float = Z95) -> DataFrame:
    """z_value, ci_lower, ci_upper; null where the standard error is null or 0."""
    return df.withColumns({"z_value": F.try_divide(F.col(estimate), F.col(se)), "ci_lower": F.col(estimate) - z * F.col(se), "ci_upper": F.col(estimate) + z * F.col(se)})


def goodness(df: DataFrame, observed: str = "observed", expected: str = "expected", parameters: int = 0, by: tuple[str, ...] = (), with_p: bool = False) -> DataFrame:
    """Pearson and deviance statistics, cells, degrees of freedom (at least 1), c_hat (at least 1), overdispersed, and p values; one row, or one a group."""
    o, e = F.col(observed).cast("double"), F.greatest(F.col(expected), F.lit(1e-10))
    stat = df.groupBy(*by).agg(
        F.sum(F.power(o - e, F.lit(2.0)) / e).alias("pearson"),
        F.sum(F.when(o > 0, 2.0 * o * F.ln(F.greatest(o, F.lit(1e-10)) / e)).otherwise(0.0)).alias("deviance"), F.count(F.lit(1)).alias("cells"),
    )
    stat = stat.withColumn("df", F.greatest(F.col("cells") - 1 - parameters, F.lit(1)))
    stat = stat.withColumn("c_hat", F.greatest(F.col("pearson") / F.col("df"), F.lit(1.0))).withColumn("overdispersed", F.col("pearson") / F.col("df") > 1.5)
    if with_p:
        stat = stat.withColumns({f"{c}_p": chi2_p(F.col(c), F.col("df")) for c in ("pearson", "deviance")})
    return stat


def residuals(df: DataFrame, observed: str = "observed", expected: str = "expected") -> DataFrame:
    """pearson, deviance (signed; 0 observed gives -sqrt(2 e)) and standardised residuals."""
    o, e = F.col(observed).cast("double"), F.greatest(F.col(expected), F.lit(1e-10))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pearson = (o - e) / F.sqrt(e)
    dev = F.when(o > 0, F.signum(o - e) * F.sqrt(F.greatest(2.0 * (o * F.ln(F.greatest(o, F.lit(1e-10)) / e) - (o - e)), F.lit(0.0)))).otherwise(-F.sqrt(2.0 * e))
    share = F.greatest(1.0 - e / F.sum(e).over(whole), F.lit(1e-10))  # over cells, a small table
    return df.withColumns({"pearson": pearson, "deviance": dev, "standardised": pearson / F.sqrt(share)})


def quick_fit_test(df: DataFrame, ll: str = "log_likelihood", n: str = "n", k: str = "n_parameters", with_p: bool = True) -> DataFrame:
    """Deviance -2 LL, its degrees of freedom n - k, their ratio, and the chi-square p value."""
    out = df.withColumns({"deviance": -2.0 * F.col(ll), "df": F.col(n) - F.col(k)})
    out = out.withColumn("c_hat", F.try_divide(F.col("deviance"), F.col("df").cast("double")))
    return out.withColumn("p", chi2_p(F.col("deviance"), F.greatest(F.col("df"), F.lit(1)))) if with_p else out


def diagnostics(cells: DataFrame, log_likelihood: float, n_parameters: int, n: int, with_p: bool = True) -> DataFrame:
    """One row: goodness of fit over cells, then criteria, divided by c_hat where the data are overdispersed."""
    g = goodness(cells, parameters=n_parameters, with_p=with_p)
    one = g.withColumnRenamed("deviance", "g2").withColumns({"log_likelihood": F.lit(float(log_likelihood)), "n_parameters": F.lit(n_parameters), "n": F.lit(n)})
    one = with_criteria(one)
    c = F.when(F.col("overdispersed"), F.col("c_hat")).otherwise(F.lit(1.0))
    return one.withColumns({"qaic": F.col("aic") / c, "qaicc": F.col("aicc") / c})


def pairwise(df: DataFrame, ic: str = "aic", id_col: str = "model_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Every two models (they are few): difference and relative likelihood, and differences by the criteria ``also``."""
    if (n := df.count()) > MOST_MODELS:
        raise ValueError(f"{n} models to pair; at most {MOST_MODELS}")
    side = lambda s: df.select(F.col(id_col).alias(f"{s}_id"), F.col(ic).alias(s), *[F.col(c).alias(f"{s}_{c}") for c in also])
    more = [(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"delta_{c}") for c in also]
    both = side("a").join(side("b"), F.col("a_id") < F.col("b_id"))
    return both.select("a_id", "b_id", (F.col("a") - F.col("b")).alias("delta"), *more, F.exp(-F.abs(F.col("a") - F.col("b")) / 2.0).alias("relative_likelihood"))


def growth_summary(df: DataFrame, value: Column, weight: str | None = None) -> DataFrame:
    """mean, median, sd (over n), least, most and quartiles of the growth rate; ``weight`` counts the individuals of a row.

    The quantiles are exact, from refined histograms: no task holds the column.
    """
    s = summary(df, value, (0.25, 0.5, 0.75), F.col(weight) if weight else None)
    row = (s.mean, s.quantiles[0.5], s.sd, s.least, s.most, s.quantiles[0.25], s.quantiles[0.75])
    return df.sparkSession.createDataFrame([row], "mean double, median double, sd double, least double, most double, q25 double, q75 double")


def reference_growth(params: DataFrame, group: str) -> DataFrame:
    """Growth of the reference individual by group, from intercepts in long form (param, estimate)."""
    wide = params.where("term = '(Intercept)'").groupBy(group).pivot("param", ["phi", "p", "f"]).agg(F.first("estimate"))
    return wide.withColumn("lambda", links.inv_logit("phi") + F.exp("f"))
