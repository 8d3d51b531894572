"""Rank correlations by inversion counts against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.operators import agree, ranks

rng = np.random.default_rng(12)


def by_pairs(a, b):
    s, t = np.sign(a[:, None] - a[None, :]), np.sign(b[:, None] - b[None, :])
    up = np.triu_indices(len(a), 1)
    s, t = s[up], t[up]
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    ra, rb = rank(a), rank(b)
    rho = np.corrcoef(ra, rb)[0, 1] if ra.std() and rb.std() else None
    return {"n": len(a), "pairs": len(s), "concordant": int((s * t > 0).sum()), "discordant": int((s * t < 0).sum()), "ties_a": int((s == 0).sum()), "ties_b": int((t == 0).sum()), "rho": rho, "exact": float((ra == rb).mean())}


def test_inversions():
    for n in (0, 1, 2, 7, 64, 200):
        x, y, w = rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 4, n)
        assert ranks.inversions(x, y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
    big = np.array([2**33, 2**33])
    assert ranks.inversions(np.array([1, 2]), np.array([2, 1]), big) == 2**66


N = 900
CASES = {
    "free": (rng.normal(size=N), rng.normal(size=N)), "alike": ((x := rng.normal(size=N)), x + rng.normal(0, 0.2, N)), "ties": (rng.integers(0, 12, N).astype(float), rng.integers(0, 30, N).astype(float)),
    "hot": (np.where(rng.random(N) < 0.4, 0.5, rng.random(N)), np.where(rng.random(N) < 0.4, 0.5, rng.random(N))), "copies": (np.repeat(rng.normal(size=N // 9), 9), np.repeat(rng.normal(size=N // 9), 9)),
    "constant": (np.ones(50), rng.normal(size=50)), "reversed": (np.arange(300.0), -np.arange(300.0)), "zeros": (np.array([0.0, -0.0, 1.0, 0.0]), np.array([1.0, 2.0, -0.0, 0.0])), "one": (np.ones(1), np.ones(1)),
}


@pytest.mark.parametrize("name", list(CASES))
def test_against_all_pairs(spark, name):
    a, b = CASES[name]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)] + [(None, 1.0), (1.0, None), (float("nan"), 2.0)], "a double, b double")
    want = by_pairs(a, b)
    for rows in (25, 10**6):
        got = ranks.rank_counts(df, F.col("a"), F.col("b"), rows)
        assert {k: v for k, v in got.items() if k not in ("rho", "exact")} == {k: v for k, v in want.items() if k not in ("rho", "exact")}
        assert got["rho"] == (None if want["rho"] is None else pytest.approx(want["rho"], abs=1e-9)) and got["exact"] == pytest.approx(want["exact"])


def test_a_million_rows(spark):
    """Against the inversions of the whole in one array."""
    df = spark.range(1_000_000).select((F.xxhash64("id") % 50_000).cast("double").alias("a"), F.col("id"))
    df = df.select("a", (F.col("a") + F.xxhash64("id", F.lit(1)) % 40_000).alias("b"))
    p = df.toPandas()
    row = agree.rank_agreement(df, "a", "b").first()
    assert row["discordant"] == ranks.inversions(p["a"].to_numpy(), p["b"].to_numpy(), np.ones(len(p), np.int64))
    assert row["pairs"] == 10**6 * (10**6 - 1) // 2 and row["rho"] == pytest.approx(p["a"].corr(p["b"], method="pearson"), abs=0.05)
    assert row["rho"] == pytest.approx(p["a"].rank().corr(p["b"].rank()), abs=1e-9)


def test_nothing_to_rank(spark):
    row = agree.rank_agreement(spark.createDataFrame([], "a double, b double"), "a", "b").first()
    assert row["pairs"] == 0 and row["tau_a"] is None and row["tau_b"] is None and row["rho"] is None
