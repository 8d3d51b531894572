"""Reproducible samples, splits, folds and bootstrap weights.

Every draw orders rows by md5 of seed and id, so results don't depend on partitions.  Ranks in that
order come from counts of 4096 hash buckets a stratum plus a rank within the bucket, so no task
sorts a whole stratum, and of a sample only buckets that can hold drawn rows are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def uniform(seed: int | str, id_col: str) -> Column:
    """In (0, 1), from the first 32 hash bits."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(2.0**32)


def ever_tier(columns: Sequence[str], least: int = 2) -> Column:
    """True if any tier column reaches ``least``; what isn't a number counts as none."""
    return F.coalesce(F.greatest(*[F.coalesce(F.col(c).try_cast("double"), F.lit(-1.0)) for c in columns], F.lit(-1.0)) >= least, F.lit(False))


def tier_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "tier" in c.lower()]


def _ranked(df: DataFrame, id_col: str, seed: int, by: Column, most: Column | None = None) -> DataFrame:
    """Rows with their place ``_rank`` (from 1) in hash order within strata ``_g``, and the stratum's size ``_n``.

    With ``most`` (over ``_g`` and ``_n``), buckets that begin beyond that place are left out, which loses no row up to it.
    """
    bucket = F.conv(F.substring(order_hash(seed, id_col), 1, 3), 16, 10).cast("int")
    rows = df.withColumns({"_g": by, "_b": bucket})
    sizes = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 4096 rows a stratum
    sizes = sizes.withColumns({"_o": F.sum("_c").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_c"), "_n": F.sum("_c").over(Window.partitionBy("_g"))})
    if most is not None:
        sizes = sizes.where(F.col("_o") < most)
    sizes = sizes.select(F.col("_g").alias("_h"), F.col("_b").alias("_k"), "_o", "_n")
    rows = rows.join(sizes, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_k")))
    within = F.row_number().over(Window.partitionBy("_g", "_b").orderBy(order_hash(seed, id_col), F.col(id_col)))
    return rows.withColumn("_rank", F.col("_o") + within)


def stratified(df: DataFrame, n: int, stratum: Column, share: float = 0.5, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows, ``share`` of them from the stratum if it has as many; a shortfall on one side is made up by the other."""
    c = df.agg(F.count_if(stratum).alias("a"), F.count_if(~stratum).alias("b")).first()
    if n >= c["a"] + c["b"]:
        return df
    a = min(int(n * share), c["a"])
    b = min(n - a, c["b"])
    a = min(n - b, c["a"])
    most = F.when(F.col("_g"), a).otherwise(b)
    return _ranked(df, id_col, seed, stratum, most).where(F.col("_rank") <= most).select(*df.columns)


def train_validation(df: DataFrame, share: float, stratum: Column, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``validation`` flag: per stratum max(1, int(n * share)) rows in hash order."""
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(share))))
    return _ranked(df, id_col, seed, stratum).withColumn("validation", F.col("_rank") <= quota).select(*df.columns, "validation")


def sample_summary(original: DataFrame, sample: DataFrame, stratum: Column) -> DataFrame:
    """One row: sizes, their ratio and the stratum's share before and after."""
    part = lambda df, k: df.agg(F.count(F.lit(1)).alias(f"n_{k}"), F.avg(stratum.cast("double")).alias(f"share_{k}"))
    one = part(original, "original").crossJoin(F.broadcast(part(sample, "sample")))  # one row each
    return one.withColumn("ratio", F.try_divide(F.col("n_sample").cast("double"), F.col("n_original").cast("double")))


def subset(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in a table of ids."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def folds(df: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1: near-equal parts of the hash order, by hash range, so no global sort."""
    return df.withColumn("fold", F.least(F.lit(k - 1), F.floor(uniform(seed, id_col) * k)).cast("int"))


def exact_folds(df: DataFrame, k: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``fold`` by contiguous slices of the hash order; the last takes the remainder.

    Ranks come from counts of hash buckets plus a rank within the bucket, so no task sorts all rows.
    """
    bucket = F.conv(F.substring(order_hash(seed, id_col), 1, 3), 16, 10).cast("int")  # 4096 ranges
    rows = df.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = sizes.withColumn("_o", F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(order_hash(seed, id_col), F.col(id_col)))
    out = rows.join(F.broadcast(before.select("_b", "_o", "_n")), "_b").withColumn("_r", F.col("_o") + within - 1)  # at most 4096 rows
    return out.withColumn("fold", F.least(F.lit(k - 1), F.floor(F.col("_r") / F.greatest(F.lit(1), F.floor(F.col("_n") / k)))).cast("int")).select(*df.columns, "fold")


def batches(df: DataFrame, size: int, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """``batch``: about ``size`` rows each of ``n``, by hash."""
    return df.withColumn("batch", F.floor(uniform(seed, id_col) * max(1, -(-n // size))).cast("int"))


def poisson_steps() -> list[float]:
    """Poisson(1) probabilities of at most 0, 1, ... up to the greatest hash-uniform."""
    total, term, out = 0.0, 0.36787944117144233, []
    while total < 1 - 2.0**-33:
        total += term
        out.append(total)
        term /= len(out)
    return out


def poisson_weight(seed: int | str, id_col: str) -> Column:
    """A Poisson(1) bootstrap weight from the hash-uniform, by inversion."""
    u = uniform(seed, id_col)
    out = F.lit(0)
    for total in poisson_steps():
        out = out + F.when(u > F.lit(total), 1).otherwise(0)
    return out
