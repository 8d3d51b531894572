"""Derivatives, many fits in step, resumed jobs, other models, traces."""

import numpy as np
import pytest
from grouped import rows
from pyspark.sql import functions as F

from fieldmark.functions import dual
from fieldmark.operators import many, monitor
from fieldmark.operators.fit import (
    BOUNDS, MODELS, Model, Penalty, Problem, Spec, bootstrap, bootstrap_summary, cross_validated, fit, fit_models, formula_grid, parameters, register_model, rows_of_model, selection_workflow, sums,
)
from fieldmark.sources.histories import CaptureFrame, from_strings


@pytest.fixture(scope="module")
def dipper(spark):
    frame = from_strings(spark.createDataFrame(rows(), "id long, ch string, sex string"), id_col="id")
    df = frame.df.withColumn("weight", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 500.0 - 1.0)).cache()
    return CaptureFrame(df, frame.occasions, frame.names, ("sex", "weight"))


def test_dual_numbers_against_closed_forms():
    x, y = dual.variables([np.array([0.3, 1.2]), np.array([2.0, 0.7])])
    z = dual.exp(x * y) / (1 + y) - 3 * dual.log(x) + (2 - y) ** np.array([3, 0])
    e, a, b = np.exp(x.v * y.v), x.v, y.v
    n = np.array([3, 0])
    assert z.v == pytest.approx(e / (1 + b) - 3 * np.log(a) + (2 - b) ** n, abs=1e-13)
    assert z.g[0] == pytest.approx(b * e / (1 + b) - 3 / a, abs=1e-13)
    assert z.g[1] == pytest.approx(a * e / (1 + b) - e / (1 + b) ** 2 - n * (2 - b) ** np.array([2, 0]), abs=1e-12)
    assert z.h[0, 0] == pytest.approx(b * b * e / (1 + b) + 3 / a**2, abs=1e-12)
    assert z.h[0, 1] == pytest.approx(e * (1 + a * b) / (1 + b) - b * e / (1 + b) ** 2, abs=1e-12) and z.h[0, 1] == pytest.approx(z.h[1, 0])
    s = dual.where(np.array([True, False]), dual.at_least(x, 0.5), dual.between(y, 0.0, 0.6))
    assert s.v.tolist() == [0.5, 0.6] and not s.g.any() and not s.h.any()
    assert dual.sigmoid(x).h[0, 0] == pytest.approx(dual.sigmoid(x.v) * (1 - dual.sigmoid(x.v)) * (1 - 2 * dual.sigmoid(x.v)))


def test_second_derivatives_against_complex_free_differences():
    """Of a penalised objective, by fourth-order differences of the exact gradient."""
    r = np.random.default_rng(3)
    n, t = 50, 7
    e = r.integers(0, 5, n)
    l = np.minimum(e + r.integers(0, 3, n), t - 1)  # noqa: E741
    x = np.where(l > e, 2, r.integers(0, 2, n))
    one, z = np.ones((n, 1)), r.normal(size=(n, 1))
    q = Problem(*(v.astype(float) for v in (x, e, l, r.integers(1, 9, n))), (np.hstack([one, z]), one, np.hstack([one, z])), t)
    p = Penalty(beta=0.4, recruitment=0.2, barrier=3.0)
    at = lambda th: sums(th, q, p, float(q.n.sum()))
    theta, step = np.array([0.3, 0.1, 0.5, -1.0, 0.2]), 1e-3
    for i in range(5):
        d = np.eye(5)[i] * step
        g = lambda k: at(theta + k * d)[2:7]
        assert at(theta)[7:].reshape(5, 5)[i] == pytest.approx((8 * (g(1) - g(-1)) - (g(2) - g(-2))) / (12 * step), rel=1e-9, abs=1e-8)


MODELS_TO_FIT = [Spec(), Spec("~weight"), Spec("~weight", "~sex", "~1")]


def test_models_in_step_agree_with_arrays(dipper):
    near, far = ({r["model_id"]: r for r in fit_models(dipper, MODELS_TO_FIT, local_rows=k).collect()} for k in (10**6, 3))
    for i in range(3):
        assert far[i]["log_likelihood"] == pytest.approx(near[i]["log_likelihood"], abs=1e-7) and far[i]["lambda_mean"] == pytest.approx(near[i]["lambda_mean"], abs=1e-6)
        assert [q["estimate"] for q in far[i]["params"]] == pytest.approx([q["estimate"] for q in near[i]["params"]], abs=1e-5)
        assert [q["se"] for q in far[i]["params"]] == pytest.approx([q["se"] for q in near[i]["params"]], rel=1e-4)


@pytest.mark.parametrize("share", [None, 0.3])
def test_cross_validation_in_step_agrees_with_arrays(dipper, share):
    key = lambda r: (r["model_id"], r["repeat"], r["fold"])
    near, far = ({key(r): r for r in cross_validated(dipper, MODELS_TO_FIT[:2], k=3, repeats=2, share=share, local_rows=k).collect()} for k in (10**6, 3))
    assert near.keys() == far.keys() and len(near) == (12 if share is None else 4)
    for k, a in near.items():
        b = far[k]
        assert (a["train_n"], a["val_n"], a["converged"]) == (b["train_n"], b["val_n"], b["converged"]) and a["train_n"] + a["val_n"] == 294
        assert (b["train_ll"], b["val_ll"]) == pytest.approx((a["train_ll"], a["val_ll"]), abs=1e-5)


def test_selection_in_step_agrees_with_arrays(dipper):
    near, far = ([tuple(r) for r in selection_workflow(dipper, MODELS_TO_FIT, local_rows=k).orderBy("model_id").select("model_id", "ic_rank", "loss_rank", "label").collect()] for k in (10**6, 3))
    assert near == far


def spark_jobs(spark, f):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, group)
    f()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_replicates_in_step(spark, dipper):
    few, more = (spark_jobs(spark, lambda n=n: bootstrap(dipper, Spec(), replicates=n, local_rows=3).collect()) for n in (5, 60))
    assert more <= few + 6  # a round or two more, not twelve times as many
    got = {r["param"]: r for r in bootstrap_summary(bootstrap(dipper, Spec(), replicates=150, local_rows=3)).collect()}
    want = {r["param"]: r for r in bootstrap_summary(bootstrap(dipper, Spec(), replicates=150)).collect()}
    for k in ("phi", "p", "f"):
        assert got[k]["se"] == pytest.approx(want[k]["se"], rel=0.3) and got[k]["mean"] == pytest.approx(want[k]["mean"], abs=3 * want[k]["se"] / 150**0.5)
    with pytest.raises(ValueError, match="fit function"):
        bootstrap(dipper, replicates=2, local_rows=3, fit_fn=lambda pdf: {})


def test_draws():
    u = many.uniforms(np.arange(200_000), 3)
    assert u.mean() == pytest.approx(0.5, abs=0.005) and np.corrcoef(u, many.uniforms(np.arange(200_000), 4))[0, 1] == pytest.approx(0, abs=0.01)
    for mean in (1.0, 7.0, 900.0):
        d = many.poisson(np.full(200_000, mean), u)
        assert d.mean() == pytest.approx(mean, rel=0.01) and d.var() == pytest.approx(mean, rel=0.02)


def test_a_job_that_fails_keeps_its_finished_models(spark, dipper, tmp_path):
    """One model's task fails as long as a file is there; the others' fits stay, and only the rest is fitted again."""
    flag, store, count = tmp_path / "fail", str(tmp_path / "fits"), tmp_path / "count"
    count.mkdir()

    def fragile(etas, q, penalty, total):
        import os
        import time
        import uuid

        (count / uuid.uuid4().hex).touch()
        if q.designs[0].shape[1] == 2 and q.designs[1].shape[1] == 2 and os.path.exists(flag):
            time.sleep(8)  # the others end first
            raise RuntimeError("executor lost")
        return rows_of_model(etas, q, penalty, total)

    register_model(Model("fragile", fragile, BOUNDS, growth=MODELS["temporal_symmetry"].growth))
    specs = formula_grid(["~1", "~sex"], ["~1", "~sex"], ["~1"])
    flag.touch()
    with pytest.raises(Exception, match="executor lost"):
        fit_models(dipper, specs, model="fragile", store=store)
    kept = {r["model_id"]: r["log_likelihood"] for r in spark.read.parquet(store).collect()}
    assert kept and 3 not in kept
    flag.unlink()
    for f in count.iterdir():
        f.unlink()
    got = {r["model_id"]: r["log_likelihood"] for r in fit_models(dipper, specs, model="fragile", store=store).collect()}
    assert sorted(got) == [0, 1, 2, 3] and {k: got[k] for k in kept} == kept and got[3] == pytest.approx(-714.386607, abs=1e-5)
    evaluations = len(list(count.iterdir()))
    assert fit_models(dipper, specs, model="fragile", store=store).count() == 4 and len(list(count.iterdir())) == evaluations  # nothing left to fit
    del MODELS["fragile"]


def test_a_model_with_parameters_of_its_own(spark, dipper):
    """Recaptures given the first capture: survival and detection, no recruitment."""

    def recaptures(etas, q, penalty, total):
        phi, p = dual.sigmoid(etas[0]), dual.sigmoid(etas[1])
        span, later = q.l - q.e, q.x - 1
        ln = lambda v: dual.log(dual.at_least(v, 1e-12))
        b = phi * (1 - p)
        s = (1 - phi) / dual.at_least(1 - b, 1e-12)
        ll = span * ln(phi) + later * ln(p) + (span - later) * ln(1 - p) + ln(s + b ** (q.occasions - 1 - q.l) * (1 - s))
        ll = dual.where(q.x > 0, ll, 0.0)
        return ll, ll

    register_model(Model("recaptures", recaptures, {k: BOUNDS[k] for k in ("phi", "p")}, ("phi", "p")))
    near = fit(dipper, Spec("~sex", "~1"), model="recaptures")
    far = fit(dipper, Spec("~sex", "~1"), model="recaptures", local_rows=3)
    assert [q["param"] for q in near["params"]] == ["phi", "phi", "p"] and near["lambda_mean"] is None and far["lambda_mean"] is None
    assert far["log_likelihood"] == pytest.approx(near["log_likelihood"], abs=1e-7)
    # published estimates of the constant model for these data: survival 0.5602, detection 0.9026
    est = [1 / (1 + np.exp(-q["estimate"])) for q in fit(dipper, Spec(), model="recaptures")["params"]]
    assert est == pytest.approx([0.5602, 0.9026], abs=2e-4)
    assert parameters(fit_models(dipper, [Spec(), Spec("~sex")], model="recaptures")).count() == 5
    del MODELS["recaptures"]


def test_traces_of_fits(dipper):
    fits = fit_models(dipper, MODELS_TO_FIT[:2]).cache()
    own = {r["model_id"]: r for r in fits.collect()}
    trace = monitor.fit_traces(fits)
    s = {r["session_id"]: r for r in monitor.sessions(trace).collect()}
    for i, r in own.items():
        assert s[i]["evaluations"] == r["n_iterations"] == len(r["trace"]) and -s[i]["best"] == pytest.approx(r["log_likelihood"], abs=1e-6)
        assert s[i]["improvement"] > 0 and r["trace"][-1]["gradient"] < 1e-3
    assert {r["session_id"] for r in monitor.convergence_rate(trace).where("rate > 0").collect()} == set(own)


def test_nothing_is_grouped_where_rows_differ(dipper):
    from fieldmark.operators.fit import _prepare

    p = _prepare(dipper, {0: Spec("~weight")})
    few, left = p.settled(20)
    assert few is None and "HashAggregate" not in left._jdf.queryExecution().toString().split("== Physical Plan ==")[1] and left.count() == 294
    few, left = p.settled(10_000)
    assert left is None and few["n"].sum() == 294
