"""Model comparison, averaging, holdout and triangulation (over tables with a row a model)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overfitting_label(share: Column) -> Column:
    return F.when(share < 0.05, "good").when(share < 0.15, "moderate").otherwise("poor")


def everything():
    """The whole table as a frame; tables here hold a row a model."""
    return Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)



def support(delta: Column) -> Column:
    return F.when(delta <= 2, "substantial").when(delta <= 7, "some").otherwise("little")


def comparison(fits: DataFrame, ic: str = "aic", id_col: str = "model_id", ascending: bool = True) -> DataFrame:
    """rank, delta, weight, evidence_ratio (infinite where the weight is 0), cumulative_weight and support by an information criterion.

    Where the table says which fits converged, only those are compared.
    """
    if "converged" in fits.columns:
        fits = fits.where("converged")
    if ic not in fits.columns:
        raise ValueError(f"no column {ic!r}")
    by = Window.orderBy(F.col(ic).asc() if ascending else F.col(ic).desc(), F.col(id_col))
    out = fits.withColumn("delta", F.col(ic) - F.min(ic).over(everything()))
    out = out.withColumn("weight", F.exp(-F.col("delta") / 2.0) / F.sum(F.exp(-F.col("delta") / 2.0)).over(everything()))
    ratio = F.max("weight").over(everything()) / F.col("weight")
    out = out.withColumn("evidence_ratio", F.when(F.col("weight") == 0, float("inf")).otherwise(ratio))  # weights of far worse models underflow
    out = out.withColumn("rank", F.row_number().over(by)).withColumn("cumulative_weight", F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("support", support(F.col("delta")))


def best(fits: DataFrame, ic: str = "aic", id_col: str = "model_id", by: Sequence[str] = ()) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(ic, id_col)
    return fits.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def two_rankings(fits: DataFrame) -> DataFrame:
    """Ranks and deltas by AIC and by BIC."""
    for ic in ("aic", "bic"):
        fits = fits.withColumns({f"{ic}_rank": F.row_number().over(Window.orderBy(ic, "model_id")), f"{ic}_delta": F.col(ic) - F.min(ic).over(everything())})
    return fits


def averaged(fits: DataFrame, value: str = "lambda_mean", ic: str = "aic") -> DataFrame:
    """Weighted mean, spread between models, entropy of the weights and a label; models without a value drop out first."""
    w = comparison(fits.where(F.col(value).isNotNull()), ic)
    w = w.withColumn("m", F.sum(F.col("weight") * F.col(value)).over(everything()))
    one = w.agg(
        F.count(F.lit(1)).alias("models"), F.first("m").alias("average"), F.sqrt(F.sum(F.col("weight") * F.power(F.col(value) - F.col("m"), F.lit(2.0)))).alias("between_sd"),
        (-F.sum(F.col("weight") * F.ln(F.col("weight") + 1e-10))).alias("entropy"),
    )
    share = F.try_divide(F.col("entropy"), F.ln(F.col("models").cast("double")))
    return one.where("models >= 2").withColumn("uncertainty", F.when(share < 0.3, "low").when(share < 0.7, "moderate").otherwise("high"))


def holdout(df: DataFrame, ll: Column, train: Column, k: int) -> DataFrame:
    """One row: log-likelihood, AIC and per-individual values of both parts, difference, overfitting ratio."""
    part = lambda keep: (F.sum(F.when(keep, ll).otherwise(0.0)), F.count_if(keep))
    (a, n), (b, m) = part(train), part(~train)
    one = df.agg(a.alias("train_ll"), n.alias("train_n"), b.alias("val_ll"), m.alias("val_n"))
    one = one.withColumns({
        "train_aic": 2.0 * k - 2.0 * F.col("train_ll"), "val_aic": 2.0 * k - 2.0 * F.col("val_ll"),
        "train_each": F.try_divide(F.col("train_ll"), F.col("train_n")), "val_each": F.try_divide(F.col("val_ll"), F.col("val_n")),
    })
    one = one.withColumn("difference", F.col("train_each") - F.col("val_each"))
    one = one.withColumn("overfitting", F.try_divide(F.abs("difference"), F.abs("train_each")))
    return one.withColumn("label", overfitting_label(F.col("overfitting")))


def loss_and_ic_ranks(fits: DataFrame, loss: str, ic: str = "aic") -> DataFrame:
    return comparison(fits, ic).withColumnRenamed("rank", "ic_rank").withColumn("loss_rank", F.row_number().over(Window.orderBy(loss, "model_id")))


def holdout_summary(rows: DataFrame, loss: str, overfitting: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.avg(loss).alias("mean_loss"), F.stddev_pop(loss).alias("sd_loss"), F.avg(overfitting).alias("mean_overfitting"), F.stddev_pop(overfitting).alias("sd_overfitting"), F.count(F.lit(1)).alias("n"),
    )


def triangulated(fits: DataFrame, params: DataFrame, ic: str = "aic", sparse_risk: str = "LOW") -> tuple[DataFrame, DataFrame]:
    """(one row on the models, a row a parameter): agreement between candidate models."""
    w = comparison(fits, ic)
    models = w.agg(
        F.count(F.lit(1)).alias("models"), F.max("weight").alias("best_weight"), (1.0 - F.max("weight")).alias("uncertainty"),
        F.count_if(F.col("delta") <= 2).alias("supported"), F.try_divide(F.stddev_pop(ic), F.avg(ic)).alias("ic_cv"),
    )
    label = F.when(F.lit(sparse_risk == "HIGH"), "high risk").when(F.col("supported") == 1, "clear preference").when(F.col("supported") > 3, "high uncertainty").otherwise("moderate uncertainty")
    models = models.withColumn("assessment", label)
    each = params.groupBy("param", "term").agg(
        F.min("estimate").alias("least"), F.max("estimate").alias("most"), (F.max("estimate") - F.min("estimate")).alias("range"),
        F.try_divide(F.stddev_pop("estimate"), F.abs(F.avg("estimate"))).alias("cv"), F.count(F.lit(1)).alias("models"),
    )
    return models, each
