"""Exact quantiles against sorted arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import quantile

QS = (0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0)
rng = np.random.default_rng(8)
COLUMNS = {
    "normal": rng.normal(0, 1, 30_000), "heavy": np.exp(rng.normal(0, 40, 20_000)) * rng.choice([-1, 1], 20_000), "ties": rng.integers(-3, 4, 30_000).astype(float),
    "hot": np.where(rng.random(30_000) < 0.4, 0.1, rng.normal(0.1, 1e-12, 30_000)), "near": 1.0 + rng.integers(0, 20_000, 30_000) * 2.0**-52,
    "tiny": rng.normal(0, 5e-324 * 1e4, 5_000), "ends": np.concatenate([[-math.inf, math.inf, 0.0, -0.0, 1.7e308, -1.7e308], rng.normal(0, 1e307, 20_000)]), "one": np.array([7.5]),
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_against_a_sorted_array(spark, name, monkeypatch):
    monkeypatch.setattr(quantile, "FEW", 50)  # so that small columns are refined, too
    v = COLUMNS[name]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "a double")
    got = quantile.summary(df, F.col("a"), QS)
    s = np.sort(v)
    for q in QS:
        at = q * (len(s) - 1)
        low, high = math.floor(at), math.ceil(at)
        want = s[low] if s[low] == s[high] else (high - at) * s[low] + (at - low) * s[high]
        assert got.quantiles[q] == want, q
    assert (got.n, got.least, got.most) == (len(v), s[0], s[-1])
    if np.isfinite(v).all() and name not in ("heavy", "near"):
        assert got.mean == pytest.approx(v.mean(), abs=1e-9) and got.sd == pytest.approx(v.std(), rel=1e-4, abs=1e-9)


def test_counts_and_spark_agree(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id") % 997 / 7.0).alias("a"), (F.col("id") % 4).alias("w"))
    got = quantile.quantiles(df, F.col("a"), QS, F.col("w"))
    assert got == df.agg(F.percentile("a", F.array(*[F.lit(q) for q in QS]), F.col("w"))).first()[0]
    assert quantile.quantiles(df.where("false"), F.col("a"), [0.5]) == [None]


def test_scans_are_few(spark):
    """A million values: powers of two, one refinement, the rest fetched."""
    df = spark.range(1_000_000).select((F.xxhash64("id") / 2.0**63).alias("a"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("scans", "scans")
    got = quantile.median(df, F.col("a"))
    jobs = tracker.getJobIdsForGroup("scans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8  # an aggregate is two jobs where the shuffle is planned adaptively
    assert got == df.agg(F.percentile("a", F.lit(0.5))).first()[0]
