"""Simulated open populations with known parameters, from ids and hashes only."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fieldmark.sources.histories import CaptureFrame, summarised


def _uniform(seed: int, *parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") + 0.5) / F.lit(2.0**53)


def simulated(spark: SparkSession, n: int, occasions: int, phi: float = 0.7, p: float = 0.6, seed: int = 42) -> CaptureFrame:
    """``n`` individuals that enter at a uniform occasion, survive each step with ``phi``, are detected with ``p``.

    Only those ever detected are kept, with ``sex`` F or M.
    """
    entry = F.floor(_uniform(seed, F.col("id"), F.lit("entry")) * occasions)
    steps = F.floor(F.ln(_uniform(seed, F.col("id"), F.lit("life"))) / F.ln(F.lit(phi)))
    df = spark.range(n).withColumns({"a": entry, "z": entry + steps, "sex": F.when(_uniform(seed, F.col("id"), F.lit("sex")) < 0.5, "F").otherwise("M")})
    seen = lambda t: (t >= F.col("a")) & (t <= F.col("z")) & (_uniform(seed, F.col("id"), t) < p)
    df = df.withColumn("h", F.transform(F.sequence(F.lit(0), F.lit(occasions - 1)), lambda t: F.when(seen(t), 1).otherwise(0))).drop("a", "z")
    df = summarised(df.withColumn("ch", F.array_join("h", "")), occasions).where("x > 0")
    return CaptureFrame(df, occasions, covariates=("sex",))
