"""Tail probabilities as columns against the scalar functions and published values."""

import math

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import dist, tails


def column(spark, rows, schema, f):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(f).collect()]


def test_t(spark):
    rows = [(t, float(df)) for df in (1, 2, 3, 7.5, 30, 200, 5000) for t in (-30.0, -3.0, -0.5, 0.0, 1e-6, 0.4, 1.0, 2.0, 12.706204736432095, 60.0)]
    got = column(spark, rows, "t double, df double", tails.t_sf(F.col("t"), F.col("df")))
    for (t, df), p in zip(rows, got):
        want = dist.t_cdf(-t, df)
        assert p == pytest.approx(want, rel=1e-9, abs=1e-14), (t, df)
    assert got[8] == pytest.approx(0.025, abs=1e-12)
    large = column(spark, [(1.959963984540054, 1e6), (0.0, 1e9), (-3.0, 1e5), (None, 3.0)], "t double, df double", tails.t_sf(F.col("t"), F.col("df")))
    assert large[:3] == pytest.approx([0.025, 0.5, dist.t_cdf(3.0, 1e5)], abs=1e-6) and large[3] is None


def test_chi_square(spark):
    rows = [(x * df, float(df)) for df in (1, 2, 3, 5, 40, 500, 7999) for x in (0.0, 1e-4, 0.3, 0.9, 1.0, 1.1, 1.5, 3.0)]
    got = column(spark, rows, "x double, df double", tails.chi2_sf(F.col("x"), F.col("df")))
    for (x, df), p in zip(rows, got):
        assert p == pytest.approx(dist.chi2_sf(x, df), rel=1e-8, abs=1e-12), (x, df)
    # either side of the expansion's start, and far beyond it
    for df in (8001.0, 2e5):
        xs = [df + k * math.sqrt(2 * df) for k in (-4, -2, -0.5, 0, 0.01, 0.5, 2, 4)]
        wide = column(spark, [(x, df) for x in xs], "x double, df double", tails.chi2_sf(F.col("x"), F.col("df")))
        # Wilson and Hilferty's cube root, good to some 1e-5 here
        cube = [0.5 * math.erfc(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2)) for x in xs]
        assert wide == pytest.approx(cube, abs=2e-5)
    edge = column(spark, [(8100.0, 7999.9), (8100.0, 8000.1)], "x double, df double", tails.chi2_sf(F.col("x"), F.col("df")))
    assert edge[0] == pytest.approx(edge[1], abs=1e-3)
    assert column(spark, [(8100.0, 8000.0)], "x double, df double", tails.gamma_q(F.col("df") / 2, F.col("x") / 2))[0] == pytest.approx(dist.chi2_sf(8100.0, 8000.0), abs=1e-9)
    assert column(spark, [(None, 3.0), (2.0, None)], "x double, df double", tails.chi2_sf(F.col("x"), F.col("df"))) == [None, None]


def test_gamma_and_normal(spark):
    xs = [0.5, 1.0, 1.5, 3.2, 50.0, 4000.5]
    assert column(spark, [(x,) for x in xs], "x double", tails.log_gamma(F.col("x"))) == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-13)
    zs = [-6.0, -1.0, 0.0, 0.3, 1.959963984540054, 8.0]
    assert column(spark, [(z,) for z in zs], "z double", tails.normal_sf(F.col("z"))) == pytest.approx([0.5 * math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-10, abs=1e-16)
