"""Every query with SQL against DuckDB, the anchors of the fits, and a few edge cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark import plans
from fieldmark.operators import agree, infer, sampling, select, sparse
from fieldmark.operators.fit import Penalty, Spec, fit
from fieldmark.plans import selection
from fieldmark.plans.base import population

TABLES = "region nation customer supplier orders events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return cols, sorted(rows, key=lambda r: [repr(v) for v in r])


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, duck, sf, name):
    cols, got = plain(plans.QUERIES[name](spark, sf).toPandas())
    want_cols, want = plain(duck.sql(plans.ORACLES[name]).df())
    assert cols == want_cols and len(got) == len(want)
    for a, b in zip(got, want):
        for u, v in zip(a, b):
            assert u == v or u == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_fit_anchors(spark, sf):
    r = fit(population(spark, sf))
    assert r["log_likelihood"] == pytest.approx(-416.756878, abs=1e-5)
    closed = fit(population(spark, sf, "closed"))
    assert closed["log_likelihood"] == pytest.approx(-895.204188, abs=1e-3) and closed["params"][2]["at_bound"] and closed["params"][2]["se"] is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_others_give_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def pair_table(spark, rows):
    return spark.createDataFrame([(f"phi_{i}", *map(float, r)) for i, r in enumerate(rows)], "param string, est_a double, se_a double, est_b double, se_b double")


def test_equivalence(spark):
    got = agree.equivalence(pair_table(spark, [(0.85, 0.005, 0.851, 0.005), (0.85, 0.05, 0.75, 0.05), (0.5, 0, 0.5, 0)]), with_p=True).orderBy("param").collect()
    assert [r["status"] for r in got] == ["EQUIVALENT", "NOT_EQUIVALENT", "INCONCLUSIVE"]


def test_concordance(spark):
    same = [(v, 0.1, v, 0.1) for v in (0.8, 0.85, 0.9, 0.75, 0.82)]
    one = agree.concordance(pair_table(spark, same)).first()
    assert one["ccc"] == pytest.approx(1) and one["mae"] == 0 and one["category"] == "excellent"
    biased = agree.concordance(pair_table(spark, [(a + 0.05, s, b, s) for a, s, b, _ in same])).first()
    assert biased["bias"] == pytest.approx(0.05) and biased["ccc"] < 1
    with pytest.raises(ValueError):
        agree.concordance(pair_table(spark, same[:1]))


def test_bootstrap_intervals(spark):
    p = pair_table(spark, [(v, 0.1, v - 0.1, 0.1) for v in (0.2, 0.5, 0.9, 0.7, 0.4)])
    reps = agree.bootstrap_difference(p, replicates=200).cache()
    one = agree.bootstrap_intervals(reps, 0.1).first()
    assert reps.count() == 200 and one["percentile_lower"] <= 0.1 + 1e-9 and one["mean"] == pytest.approx(0.1)
    lo, hi = agree.bca_interval(agree.bootstrap_difference(p, lambda x, y: float(x.mean()), 200), 0.54, 0.02)
    assert lo < 0.54 < hi


def test_intervals_of_a_large_table(spark):
    """20,000 pairs, far beyond what was once gathered: moments, replicates and all five intervals against numpy."""
    rng = np.random.default_rng(4)
    a, b = rng.gamma(2.0, 1.0, 20_000), rng.normal(1.5, 1.0, 20_000)
    a[:4000], b[:4000] = 3.0, 1.0  # a difference that many pairs share
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "est_a double, est_b double")
    d = a - b
    left_out = (d.sum() - d) / (len(d) - 1)
    u = left_out.mean() - left_out
    one = agree.jackknife(df).first()
    assert one["acceleration"] == pytest.approx((u**3).sum() / (6 * (u**2).sum() ** 1.5), rel=1e-6)
    assert one["se"] == pytest.approx(np.sqrt((len(d) - 1) / len(d) * (u**2).sum()), rel=1e-6)
    reps = agree.mean_replicates(df, 400, 1).toPandas()
    assert reps["value"].std() == pytest.approx(one["se"], rel=0.12) and reps["se"].mean() == pytest.approx(one["se"], rel=0.05)
    row = agree.difference_intervals(df, 400, 1).first()
    half = 1.96 * one["se"]
    for kind in ("percentile", "basic", "t", "bca", "studentised"):
        assert row[f"{kind}_lower"] == pytest.approx(d.mean() - half, abs=0.35 * half) and row[f"{kind}_upper"] == pytest.approx(d.mean() + half, abs=0.35 * half), kind


def test_nested_replicates(spark):
    rng = np.random.default_rng(6)
    p = pair_table(spark, [(v, 0.1, v - 0.1 + e, 0.1) for v, e in zip(rng.normal(0, 1, 40), rng.normal(0, 0.2, 40))])
    observed = p.agg(F.avg(F.col("est_a") - F.col("est_b"))).first()[0]
    reps = agree.bootstrap_difference(p, replicates=200, nested=40).cache()
    assert reps.agg(F.avg("se")).first()[0] == pytest.approx(agree.jackknife(p).first()["se"], rel=0.15)
    low, high = agree.studentised_interval(reps, observed)
    assert low < observed < high and high - low == pytest.approx(4 * agree.jackknife(p).first()["se"], rel=0.4)


def test_sampling_edges(spark):
    df = spark.range(20).withColumn("tier_1", F.when(F.col("id") < 3, "2").otherwise("x"))
    ever = sampling.ever_tier(["tier_1"])
    assert sampling.stratified(df, 50, ever).count() == 20
    got = sampling.stratified(df, 10, ever, 0.5)
    assert got.count() == 10 and got.where(ever).count() == 3
    v = sampling.train_validation(df, 0.01, ever).where("validation")
    assert v.count() == 2
    assert sampling.exact_folds(df, 3).groupBy("fold").count().count() == 3


def test_selection_edges(spark):
    f = spark.createDataFrame([(1, 10.0, 1.1), (2, 12.0, None)], "model_id int, aic double, lambda_mean double")
    assert select.averaged(f).count() == 0
    with pytest.raises(ValueError):
        select.comparison(f, "nope")
    one = infer.with_criteria(spark.createDataFrame([(-10.0, 3, 4)], "log_likelihood double, n_parameters int, n int")).first()
    assert one["aicc"] == float("inf") and one["aic"] == 26


def test_comparison_of_models_far_apart(spark, duck, monkeypatch):
    """Weights under 1e-300, subnormal and 0: the query and its SQL over the same fits."""
    rows = [(1, 100.0), (2, 1500.0), (3, 1515.0), (4, 1560.0), (5, 2000.0)]
    fits = f"fits(model_id, aic) AS (VALUES {', '.join(f'({i}, {v}::DOUBLE)' for i, v in rows)})"
    monkeypatch.setattr(selection, "fits", lambda spark, sf: spark.createDataFrame(rows, "model_id int, aic double"))
    cols, got = plain(selection.model_comparison(spark, "").toPandas())
    want_cols, want = plain(duck.sql(plans.ORACLES["model_comparison"].replace(selection.FITS_SQL, fits)).df())
    assert cols == want_cols and got == [pytest.approx(r) for r in want]
    evidence = {r[cols.index("model_id")]: r[cols.index("log10_evidence")] for r in got}
    assert evidence[2] == pytest.approx(700 / math.log(10)) and evidence[3] == pytest.approx(707.5 / math.log(10)) and evidence[5] == math.inf
    unknown = select.comparison(spark.createDataFrame([(1, 10.0), (2, None)], "model_id int, aic double"))
    assert {r["model_id"]: r["evidence_ratio"] for r in unknown.collect()} == {1: 1.0, 2: None}


def test_sparse_edges(spark):
    df = spark.createDataFrame([(0,), (1,), (1,)], "x int")
    one = sparse.coverage_estimate(sparse.counts(df, 3)).first()
    assert one["c_hat"] == 0 and one["reliability"] == "low" and one["variance"] is None


def test_streaming(spark, tmp_path):
    from fieldmark.streaming import suffstat as st

    spark.createDataFrame([(1, 0, "2024-01-01"), (1, 2, "2024-01-03"), (2, 1, "2024-01-02"), (1, 0, "2024-01-01")], "id long, occasion int, d string").selectExpr("id", "occasion", "to_timestamp(d) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, occasion int, ts timestamp").parquet(str(tmp_path / "in"))
    st.maintain(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert {tuple(r) for r in st.current(spark, str(tmp_path / "t"), 3).collect()} == {(2, 0, 2, 1), (1, 1, 1, 1)}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 3


def test_regularised_estimates(spark, sf):
    frame = population(spark, sf)
    one = sparse.regularised(frame).first()
    p = [q["estimate"] for q in fit(frame, penalty=Penalty(ridge=0.1, intercepts=True))["params"]]
    assert one["regularised"] == pytest.approx(one["seen"] / (sum(math.exp(v) for v in p) / 3)) and one["ci_upper"] == pytest.approx(1.3 * one["regularised"])
    by = sparse.regularised(frame, Spec("~segment"), by="detection").first()
    assert one["seen"] <= by["regularised"] < 1.5 * one["seen"]
    # a far stronger ridge draws all coefficients to nothing, and their exponentials to one
    assert sparse.regularised(frame, strength=1e6).first()["detection"] == pytest.approx(1.0, abs=0.01)
    rows = [(s, 100.0, 30, 10, 20, 200, 7, 150.0) for s in ("LOW", "MODERATE", "HIGH", "EXTREME")]
    df = spark.createDataFrame(rows, "severity string, n double, once int, twice int, never int, captures int, occasions int, r double").withColumn("multiple", F.lit(50))
    got = {r["severity"]: r for r in sparse.consensus(df, "r").collect()}
    assert got["LOW"]["consensus"] == got["LOW"]["estimate"] and got["EXTREME"]["consensus"] == (got["EXTREME"]["estimate"] + got["EXTREME"]["point"]) / 2
    assert got["HIGH"]["consensus"] == (got["HIGH"]["estimate"] + 150.0) / 2 == got["MODERATE"]["consensus"]
    assert sparse.consensus(df.where("severity = 'HIGH'")).first()["method"] == "sample_coverage"
