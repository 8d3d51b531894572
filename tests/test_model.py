"""Golden estimates, identities and derivatives of the model."""

import math

import numpy as np
import pytest
from grouped import rows
from pyspark.sql import functions as F

from fieldmark.functions import dist, links
from fieldmark.functions.formula import FormulaError, describe, design, parse
from fieldmark.operators import suffstat
from fieldmark.operators.fit import Problem, Spec, bootstrap, bootstrap_summary, fit, fit_models, formula_grid, parameters, value_and_gradient
from fieldmark.sources.histories import DataFormatError, from_strings


@pytest.fixture(scope="module")
def dipper(spark):
    return from_strings(spark.createDataFrame(rows(), "id long, ch string, sex string"), id_col="id")


def test_constant_model(dipper):
    r = fit(dipper)
    assert r["log_likelihood"] == pytest.approx(-715.088085, abs=1e-5) and r["aic"] == pytest.approx(1436.176171, abs=1e-5)
    assert [q["estimate"] for q in r["params"]] == pytest.approx([0.246254, 2.176363, -0.514248], abs=1e-5)
    assert [q["se"] for q in r["params"]] == pytest.approx([0.100604, 0.230497, 0.100829], abs=1e-4)
    assert r["lambda_mean"] == pytest.approx(1.159204, abs=1e-5)


@pytest.mark.parametrize("local_rows", [200_000, 3])
def test_sex_model_on_driver_and_distributed(dipper, local_rows):
    r = fit(dipper, Spec("~sex", "~sex", "~1"), local_rows=local_rows)
    assert r["log_likelihood"] == pytest.approx(-714.386607, abs=1e-5)
    assert [q["estimate"] for q in r["params"]] == pytest.approx([0.225716, 0.045207, 1.953312, 0.490634, -0.515364], abs=1e-4)


def test_many_models_and_resume(dipper):
    specs = formula_grid(["~1", "~sex"], ["~1", "~sex"], ["~1"])
    fits = fit_models(dipper, specs).cache()
    got = {r["model_id"]: r["log_likelihood"] for r in fits.collect()}
    assert len(got) == 4 and got[3] == pytest.approx(-714.386607, abs=1e-5)
    assert {r["model_id"] for r in fit_models(dipper, specs, done=fits.where("model_id < 3")).collect()} == {3}
    assert fit_models(dipper, specs, done=fits).count() == 0
    assert parameters(fits).count() == 3 + 4 + 4 + 5


@pytest.mark.parametrize("strategy", ["adam", "multi_start", "newton"])
def test_strategies_agree(dipper, strategy):
    assert fit(dipper, strategy=strategy)["log_likelihood"] == pytest.approx(-715.088085, abs=1e-4)
    with pytest.raises(ValueError):
        fit(dipper, strategy="nonsense")


def test_empirical_rates(dipper):
    e = suffstat.empirical(dipper.df, 7).first()
    assert (e["detection"], e["survival"], e["recruitment"]) == pytest.approx((0.252187, 0.509390, 0.154195), abs=1e-6)


def test_bootstrap_spread(dipper):
    got = {r["param"]: r for r in bootstrap_summary(bootstrap(dipper, replicates=30)).collect()}
    assert got["phi"]["se"] == pytest.approx(0.1, abs=0.06) and got["phi"]["replicates"] == 30


@pytest.mark.parametrize("rate,p", [(0.8, 0.5), (0.56, 0.9), (0.3, 0.2), (0.99, 0.1)])
def test_tail_is_the_recursion(spark, rate, p):
    q, want = 1.0, []
    for _ in range(6):
        want.append(q)
        q = (1 - rate) + rate * (1 - p) * q
    got = [r[0] for r in spark.range(6).orderBy("id").select(links.unseen_tail(rate, p, F.col("id"))).collect()]
    assert got == pytest.approx(want, abs=1e-14)


def test_likelihood_against_masks(spark):
    rng = np.random.default_rng(1)
    h = (rng.random((60, 7)) < 0.4).astype(int)
    phi, p, f = 0.7, 0.6, 0.3
    gamma = phi / (phi + f)

    def one(v):
        if not v.any():
            return 0.0
        e, l = int(np.argmax(v)), 6 - int(np.argmax(v[::-1]))  # noqa: E741
        seen = lambda part: sum(math.log(p) if x else math.log(1 - p) for x in part)
        tail = lambda r, n: 1.0 if n == 0 else (1 - r) + r * (1 - p) * tail(r, n - 1)
        return (l - e) * (math.log(phi) + math.log(gamma)) + seen(v[e + 1 : l + 1]) + seen(v[e:l]) + math.log(tail(gamma, e)) + math.log(tail(phi, 6 - l))

    df = from_strings(spark.createDataFrame([(i, "".join(map(str, v))) for i, v in enumerate(h)], "id int, ch string")).df
    got = [r[0] for r in df.orderBy("id").select(links.log_likelihood(phi, p, f, 7)).collect()]
    assert got == pytest.approx([one(v) for v in h], abs=1e-12)


def test_gradient_against_differences():
    rng = np.random.default_rng(2)
    n = 40
    e = rng.integers(0, 4, n)
    l = e + rng.integers(0, 3, n)  # noqa: E741
    x = np.minimum(1 + (l > e) + rng.integers(0, 2, n), l - e + 1)
    d = [np.stack([np.ones(n), rng.normal(size=n)], axis=1) for _ in range(3)]
    q = Problem(x.astype(float), e.astype(float), l.astype(float), rng.integers(1, 9, n).astype(float), tuple(d), 7)
    t = rng.normal(0, 0.5, 6)
    _, g = value_and_gradient(t, q)
    for i in range(6):
        h = np.zeros(6)
        h[i] = 1e-6
        assert (value_and_gradient(t + h, q)[0] - value_and_gradient(t - h, q)[0]) / 2e-6 == pytest.approx(g[i], rel=1e-5, abs=1e-5)


def test_formulas(spark):
    assert parse("~ a*b - 1").terms == (("a",), ("b",), ("a", "b")) and parse("~0 + a").terms == (("a",),)
    assert parse("a:b + log(x + 1)").terms == ((), ("a", "b"), ("log(x + 1)",))
    df = spark.createDataFrame([("u", 2.0), ("v", 3.0), ("w", -1.0)], "g string, z double")
    cols = design(parse("~g*z + I(z^2) + poly(z, 2)"), describe(df, ("g", "z"), 7))
    assert [n for n, _ in cols] == ["(Intercept)", "g_v", "g_w", "z", "g_v:z", "g_w:z", "I(z^2)", "poly(z, 2)1", "poly(z, 2)2"]
    got = df.select(*[c.alias(f"c{i}") for i, (_, c) in enumerate(cols)]).collect()
    assert [tuple(r) for r in got][1] == (1.0, 1.0, 0.0, 3.0, 3.0, 0.0, 9.0, 3.0, 9.0)
    for bad in ("~nope(a)", "~poly(z, 9)", "~", "~(a", "~missing"):
        with pytest.raises(FormulaError):
            design(parse(bad), describe(df, parse(bad).variables, 7))


def test_log_domain(dipper, spark):
    df = dipper.df.withColumn("z", F.col("id") - 5.0)
    from fieldmark.sources.histories import CaptureFrame

    with pytest.raises(FormulaError, match="positive"):
        fit(CaptureFrame(df, 7), Spec("~log(z)"))


def test_distributions():
    assert dist.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, rel=1e-9) and dist.t_quantile(0.975, 30) == pytest.approx(2.0422724563, rel=1e-9)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9) and dist.chi2_sf(0, 3) == 1
    assert dist.t_cdf(0, 5) == pytest.approx(0.5) and dist.t_cdf(-2, 10) == pytest.approx(1 - dist.t_cdf(2, 10))


def test_adapters_and_errors(spark, tmp_path):
    from fieldmark.sources import histories as s

    (tmp_path / "d.csv").write_text("ch,sex\n0011,F\n0100,M\n")
    assert [r["ch"] for r in s.read_table(spark, str(tmp_path / "d.csv")).orderBy("sex").collect()] == ["0011", "0100"]
    f = s.load(spark, str(tmp_path / "d.csv"))
    assert f.occasions == 4 and f.meta["adapter"] == "rmark" and f.covariates == ("sex",)
    wide = spark.createDataFrame([(1, 0, 2, None, 5.0, 6.0)], "id int, Y2016 int, Y2017 int, Y2018 int, age_1 double, age_2 double")
    g = s.to_frame(wide, id_col="id")
    assert g.df.select("h", "age").first() == ([0, 1, 0], [5.0, 6.0]) and "age" in g.covariates
    for text in ("01a", "011 "):
        with pytest.raises(DataFormatError):
            s.from_strings(spark.createDataFrame([("010",), (text,)], "ch string"))
    with pytest.raises(DataFormatError):
        s.to_frame(spark.createDataFrame([("x",)], "a string"))
    s.register_adapter("mine", lambda df: "mine" in df.columns, lambda df: "read")
    assert s.to_frame(spark.createDataFrame([("x",)], "mine string")) == "read"
    s._ADAPTERS.pop(0)
    s.export(spark.createDataFrame([(1.23456789,)], "a double"), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).first()["a"] == 1.234568


def test_recovery_and_covariance(spark, dipper):
    from fieldmark.operators.fit import covariance
    from fieldmark.sources.simulate import simulated

    est = {q["param"]: q for q in fit(simulated(spark, 3000, 7, phi=0.7, p=0.6))["params"]}
    assert 1 / (1 + math.exp(-est["phi"]["estimate"])) == pytest.approx(0.7, abs=0.05) and 1 / (1 + math.exp(-est["p"]["estimate"])) == pytest.approx(0.6, abs=0.06)
    cov = {(r["row"], r["col"]): r for r in covariance(dipper).collect()}
    assert cov["phi_(Intercept)", "phi_(Intercept)"]["covariance"] == pytest.approx(0.100604**2, rel=1e-3) and len(cov) == 9


def test_penalties_pull_and_stay_out_of_the_criteria(dipper):
    from fieldmark.operators.fit import Penalty

    spec = Spec("~sex", "~sex", "~1")
    free = fit(dipper, spec)
    tied = fit(dipper, spec, penalty=Penalty(ridge=50.0))
    slope = lambda r: [abs(q["estimate"]) for q in r["params"] if q["term"] != "(Intercept)"]
    assert max(slope(tied)) < 0.1 < max(slope(free)) and tied["log_likelihood"] < free["log_likelihood"]
    assert tied["aic"] == pytest.approx(2 * 5 - 2 * tied["log_likelihood"])
    prior = fit(dipper, penalty=Penalty(beta=5.0, shape=(2.0, 2.0)))
    assert 0 < prior["params"][1]["estimate"] < fit(dipper)["params"][1]["estimate"]
    assert fit(dipper, penalty=Penalty(recruitment=5.0))["params"][2]["estimate"] < fit(dipper)["params"][2]["estimate"]


def test_sums_match_differences():
    from fieldmark.operators.fit import Penalty, point, sums

    r = np.random.default_rng(3)
    n, t = 40, 7
    e = r.integers(0, 5, n)
    l = np.minimum(e + r.integers(0, 3, n), t - 1)  # noqa: E741
    x = np.where(l > e, 2, 1)
    one, z = np.ones((n, 1)), r.normal(size=(n, 1))
    q = Problem(x.astype(float), e.astype(float), l.astype(float), r.integers(1, 9, n).astype(float), (np.hstack([one, z]), one, np.hstack([one, z])), t)
    p, names = Penalty(ridge=0.3, beta=0.4, recruitment=0.2, barrier=3.0), [("phi", "(Intercept)"), ("phi", "z"), ("p", "(Intercept)"), ("f", "(Intercept)"), ("f", "z")]
    at = lambda th: point(th, sums(th, q, p, float(q.n.sum())), p, p.mask(names))
    theta = np.array([0.3, 0.1, 0.5, -1.0, 0.2])
    here, step = at(theta), 1e-5
    for i in range(5):
        d = np.eye(5)[i] * step
        assert here.g[i] == pytest.approx((at(theta + d).value - at(theta - d).value) / (2 * step), rel=1e-5, abs=1e-4)
        assert here.h[i] == pytest.approx((at(theta + d).g - at(theta - d).g) / (2 * step), rel=1e-4, abs=1e-3)


def test_distributed_forms_agree(dipper):
    from fieldmark.operators.fit import bootstrap_covariance, covariance

    spec = Spec("~sex", "~1", "~1")
    near, far = (fit_models(dipper, [spec], local_rows=k).first() for k in (10**6, 5))
    assert far["log_likelihood"] == pytest.approx(near["log_likelihood"], abs=1e-6)
    a, b = ({(r["row"], r["col"]): r["covariance"] for r in covariance(dipper, spec, local_rows=k).collect()} for k in (10**6, 5))
    assert all(a[k] == pytest.approx(b[k], rel=1e-4, abs=1e-8) for k in a)
    reps = bootstrap(dipper, Spec(), replicates=6, local_rows=5)
    assert reps.where("converged").count() == 18 and bootstrap_covariance(reps).count() == 9


def test_bootstrap_failures_are_told(dipper, spark):
    reps = spark.createDataFrame([(i, "phi", "(Intercept)", None if i < 3 else float(i), i >= 3) for i in range(8)], "rep int, param string, term string, estimate double, converged boolean")
    row = bootstrap_summary(reps, spark.createDataFrame([("phi", "(Intercept)", 5.0)], "param string, term string, estimate double")).first()
    assert (row["replicates"], row["failed"]) == (8, 3) and row["bias"] == pytest.approx(0.0) and row["corrected"] == pytest.approx(5.0)
    with pytest.raises(Exception, match="bootstrap fits failed"):
        bootstrap_summary(reps.withColumn("converged", F.lit(False))).collect()
    own = bootstrap(dipper, replicates=3, fit_fn=lambda pdf: {("phi", "(Intercept)"): float(pdf["n"].sum())})
    assert {r["estimate"] for r in own.where("param = 'phi'").collect()} == {294.0}


def test_registry_strategy_choice_and_watch(dipper):
    from fieldmark.operators.fit import BOUNDS, MODELS, Model, get_model, hessian_quality, register_model, rows_of_model

    seen = []
    r = fit(dipper, strategy="newton", watch=lambda *a: seen.append(a))
    assert len(seen) == r["n_iterations"] and seen[-1][2] < 1e-3
    register_model(Model("twice", lambda etas, q, penalty, total: tuple(2 * v for v in rows_of_model(etas, q, penalty, total)), BOUNDS))
    assert fit(dipper, model="twice")["log_likelihood"] == pytest.approx(2 * r["log_likelihood"], abs=1e-3)
    del MODELS["twice"]
    with pytest.raises(ValueError, match="unknown model"):
        get_model("twice")
    assert fit(dipper, strategy="auto", warm_start=True)["log_likelihood"] == pytest.approx(-715.088085, abs=1e-4)
    assert [hessian_quality(h) for h in (np.eye(2), np.zeros((2, 2)), np.diag([-1.5, 2.0]), np.diag([-3.0, -2.0]))] == ["identity", "zero", "not_concave", "good"]


def test_sampled_load(spark, tmp_path):
    from fieldmark.sources.histories import load_sampled

    rows = [(i, f"{i % 2}1{i % 3 % 2}", str(i % 4)) for i in range(200)]
    spark.createDataFrame(rows, "id long, ch string, tier_1 string").coalesce(1).write.option("header", True).csv(str(tmp_path / "d.csv"))
    train, val = load_sampled(spark, str(tmp_path / "d.csv"), 60, validation=0.2, id_col="id")
    assert (train.df.count(), val.df.count()) == (48, 12) and load_sampled(spark, str(tmp_path / "d.csv"), 60, id_col="id")[0].df.where("tier_1 >= 2").count() == 30
