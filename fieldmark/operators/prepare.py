"""Recodes, imputation and scaling, as projections or one small aggregate joined back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gender_label(c: Column) -> Column:
    """1 Male, 2 Female; anything else Male."""
    return F.when(c == 2, "Female").otherwise("Male")


def tier_history_label(c: Column) -> Column:
    return F.when(c.isNull(), "Unknown").when(c <= 1, "Tier_1").when(c <= 2, "Tier_2").when(c <= 3, "Tier_3").otherwise("Tier_Higher")


def permit_label(c: Column) -> Column:
    return F.when(c == 1, "Tier_1_Permit").when(c == 2, "Tier_2_Permit").otherwise("No_Permit")


def has_permit(c: Column) -> Column:
    return F.when(c.isin(1, 2), "Yes").otherwise("No")


def permit_choice(c: Column) -> Column:
    """The tier chosen by those with a permit."""
    return F.when(c == 1, "Tier_1").when(c == 2, "Tier_2").otherwise("None")


def _stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and standard deviation of each column."""
    return df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(v - mean) / sd with n - 1; columns without spread stay."""
    stats = F.broadcast(_stats(df, columns))  # one row
    out = df.crossJoin(stats)
    for c in columns:
        out = out.withColumn(c, F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c)))
    return out.select(*df.columns)


def mean_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = F.broadcast(df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns]))  # one row
    out = df.crossJoin(stats)
    return out.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def row_filled(df: DataFrame, array_col: str) -> DataFrame:
    """Null cells of an array covariate: the row's mean, else the mean over all cells."""
    every = F.broadcast(df.select(F.explode(array_col).alias("v")).agg(F.avg("v").alias("_m")))  # one row
    there = F.filter(array_col, lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, v: a + v), F.size(there))
    out = df.crossJoin(every).withColumn(array_col, F.transform(array_col, lambda v: F.coalesce(v, mean, F.col("_m"))))
    return out.select(*df.columns)


def looks_categorical(df: DataFrame, columns: Sequence[str], fewer_than: int = 10) -> DataFrame:
    """(column, distinct, categorical): text, or few distinct whole numbers; one aggregate for all columns."""
    kinds = dict(df.dtypes)
    aggs = []
    for c in columns:
        aggs.append(F.countDistinct(c).alias(f"d_{c}"))
        aggs.append((F.lit(True) if kinds[c] == "string" else F.bool_and(F.col(c).cast("double") == F.floor(F.col(c).cast("double")))).alias(f"w_{c}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("distinct"), F.coalesce(F.lit(kinds[c] == "string") | ((F.col(f"d_{c}") < fewer_than) & F.col(f"w_{c}")), F.lit(False)).alias("categorical")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """``<column>_code``: place of the value among its sorted levels; null is -1."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct()
    ranked = levels.withColumn("_code", F.row_number().over(Window.orderBy("_v")) - 1)  # over the levels only
    return df.join(ranked, F.col(column) == F.col("_v"), "left").withColumn(f"{column}_code", F.coalesce("_code", F.lit(-1))).drop("_v", "_code")


def annual_permits(df: DataFrame, tiers: Sequence[str], gender: str = "gender", age: str = "age") -> DataFrame:
    """Histories from yearly tiers; rows without a known gender or a positive age go before age is scaled.

    Adds ch, tier2_dummy (any tier 2), gender as 1 (M) or 0 (F), age as a z-score.
    """
    out = df.withColumns({
        "ch": F.concat(*[F.when(F.col(c) > 0, "1").otherwise("0") for c in tiers]),
        "tier2_dummy": F.greatest(*[F.when(F.col(c) == 2, 1).otherwise(0) for c in tiers]),
        gender: F.when(F.col(gender) == "M", 1).when(F.col(gender) == "F", 0),
    })
    return standardised(out.where(F.col(gender).isNotNull() & (F.col(age) > 0)).withColumn(age, F.col(age).cast("double")), [age])
