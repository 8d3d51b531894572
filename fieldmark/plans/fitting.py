"""Fits on the open population.  Most have SQL, Newton's method as a recursive query; tests hold the others against
closed forms, against each other and against published estimates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import agree, infer, monitor, prepare, sampling
from fieldmark.operators.fit import FIT_SCHEMA, PARAMETERS, Penalty, Spec, bootstrap, bootstrap_covariance, bootstrap_summary, covariance, cross_validated, fit, fit_models, formula_grid, parameters, predicted, prediction_summary, selection_workflow, strategies_compared
from fieldmark.operators.select import comparison
from fieldmark.plans.base import OPEN, ll_sql, population, query
from fieldmark.plans.newton import CONDITION, CONSTANT, inverse_sql, newton_sql
from fieldmark.sources.histories import CaptureFrame, rounded
from fieldmark.sources.simulate import simulated


_FIT = f"WITH RECURSIVE {OPEN}, {newton_sql()}, {inverse_sql()}"
_SEGMENT = ("1", *[f"CAST(segment = '{v}' AS INT)" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
_NAMES = ("(Intercept)", "segment_BUILDING", "segment_FURNITURE", "segment_HOUSEHOLD", "segment_MACHINERY")


def _designs(spec: Spec) -> list[tuple[str, ...]]:
    return [_SEGMENT if getattr(spec, k) == "~segment" else ("1",) for k in PARAMETERS]


def _terms(designs) -> list[tuple[str, str]]:
    """(parameter, term) of every coefficient."""
    return [(k, t) for k, d in zip(PARAMETERS, designs) for t in _NAMES[: len(d)]]


def _rates(designs) -> list[str]:
    """Survival, detection and recruitment of an individual at coefficients t0, t1, ..."""
    at, out = 0, []
    for d in designs:
        out.append(" + ".join(f"t{at + i} * {c}" for i, c in enumerate(d)))
        at += len(d)
    return [f"(1 / (1 + exp(-({out[0]}))))", f"(1 / (1 + exp(-({out[1]}))))", f"exp({out[2]})"]


def _estimates(designs, name: str = "") -> str:
    """Query (i, param, term, estimate, se) of a fit in SQL."""
    k = len(_terms(designs))
    cells = ", ".join(f"({i}, '{a}', '{t}')" for i, (a, t) in enumerate(_terms(designs)))
    return f"SELECT n.i, param, term, [{', '.join(f't{i}' for i in range(k))}][n.i + 1] AS estimate, sqrt(cov) AS se, ll FROM (VALUES {cells}) n(i, param, term) JOIN cov{name} c ON c.i = n.i AND c.j = n.i, opt{name}"


_TERMS = "k(i, param) AS (VALUES (0, 'phi'), (1, 'p'), (2, 'f'))"


@query("fit_constant", f"""{_FIT}, {_TERMS}, r AS (SELECT param, [t0, t1, t2][cov.i + 1] AS estimate, sqrt(cov) AS se, ll, 1 / (1 + exp(-t0)) + exp(t2) AS lambda_mean FROM cov JOIN k ON cov.i = k.i, opt WHERE cov.i = cov.j)
SELECT param, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate - 1.959963984540054 * se, 4) AS ci_lower, round(estimate + 1.959963984540054 * se, 4) AS ci_upper, round(ll, 4) AS log_likelihood,
 round(6 - 2 * ll, 4) AS aic, round(3 * ln((SELECT count(*) FROM ind)) - 2 * ll, 4) AS bic, round(lambda_mean, 4) AS lambda_mean FROM r""")
def fit_constant(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: histories from the order log, grouped statistics, constant model."""
    row = fit(population(spark, sf))
    df = spark.createDataFrame([row], FIT_SCHEMA)
    return rounded(df.select(F.explode("params").alias("q"), "log_likelihood", "aic", "bic", "lambda_mean").select("q.param", "q.estimate", "q.se", "q.ci_lower", "q.ci_upper", "log_likelihood", "aic", "bic", "lambda_mean"), 4)


CANDIDATES = [Spec(a, b, c) for a, b, c in (("~1", "~1", "~1"), ("~segment", "~1", "~1"), ("~1", "~segment", "~1"), ("~1", "~1", "~segment"), ("~segment", "~segment", "~1"), ("~segment", "~1", "~segment"))]


_SPECS = [_designs(c) for c in CANDIDATES]
_EACH = " UNION ALL ".join(
    f"SELECT {i} AS model_id, '{c.label}' AS model_name, TRUE AS converged, ll AS log_likelihood, {len(_terms(d))} AS n_parameters, CAST(n AS BIGINT) AS n, growth AS lambda_mean FROM opt_{i}"
    for i, (c, d) in enumerate(zip(CANDIDATES, _SPECS))
)


@query("fit_candidates", f"""WITH RECURSIVE {OPEN}, {', '.join(newton_sql(designs=d, name=f'_{i}') for i, d in enumerate(_SPECS))},
m AS (SELECT *, 2.0::DOUBLE * n_parameters - 2 * log_likelihood AS aic, n_parameters * ln(n) - 2 * log_likelihood AS bic FROM ({_EACH})),
c AS (SELECT *, aic - min(aic) OVER () AS delta, exp(-(aic - (SELECT min(aic) FROM m)) / 2) / (SELECT sum(exp(-(aic - (SELECT min(aic) FROM m)) / 2)) FROM m) AS weight FROM m)
SELECT model_id, model_name, converged, round(log_likelihood, 4) AS log_likelihood, n_parameters, n, round(aic, 4) AS aic, round(bic, 4) AS bic, round(lambda_mean, 4) AS lambda_mean, round(delta, 4) AS delta, round(weight, 4) AS weight,
 CAST(row_number() OVER (ORDER BY aic, model_id) AS INT) AS rank, round(sum(weight) OVER (ORDER BY aic, model_id), 4) AS cumulative_weight, CASE WHEN delta <= 2 THEN 'substantial' WHEN delta <= 7 THEN 'some' ELSE 'little' END AS support FROM c""")
def fit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate models in one job, ranked."""
    fits = fit_models(population(spark, sf), CANDIDATES).select("model_id", "model_name", "converged", "log_likelihood", "n_parameters", "n", "aic", "bic", "lambda_mean")
    return rounded(comparison(fits).drop("evidence_ratio"), 4)


@query("fit_parameters", f"""WITH RECURSIVE {OPEN}, {newton_sql(name='_0')}, {inverse_sql(3, '_0')}, {newton_sql(designs=_SPECS[1], name='_1')}, {inverse_sql(7, '_1')},
p AS (SELECT 0 AS model_id, * FROM ({_estimates(_SPECS[0], '_0')}) UNION ALL SELECT 1, * FROM ({_estimates(_SPECS[1], '_1')}))
SELECT model_id, param, term, CAST(i AS INT) AS idx, round(estimate, 4) AS estimate, round(se, 4) AS se, FALSE AS at_bound, round(estimate / se, 4) AS z_value, round(estimate - 1.959963984540054 * se, 4) AS ci_lower, round(estimate + 1.959963984540054 * se, 4) AS ci_upper FROM p""")
def fit_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(infer.wald(parameters(fit_models(population(spark, sf), formula_grid(["~1", "~segment"], ["~1"], ["~1"]))).drop("ci_lower", "ci_upper")), 4)


_ZBAL = (("1", "zbal"), ("1",), ("1",))


@query("fit_continuous", f"""WITH RECURSIVE {OPEN}, zed AS (SELECT *, (acctbal - avg(acctbal) OVER ()) / stddev_samp(acctbal) OVER () AS zbal FROM ind), {newton_sql('zed', designs=_ZBAL)}, {inverse_sql(4)},
p AS (SELECT n.i, param, term, [t0, t1, t2, t3][n.i + 1] AS estimate, sqrt(cov) AS se FROM (VALUES (0, 'phi', '(Intercept)'), (1, 'phi', 'acctbal'), (2, 'p', '(Intercept)'), (3, 'f', '(Intercept)')) n(i, param, term) JOIN cov c ON c.i = n.i AND c.j = n.i, opt)
SELECT 0 AS model_id, param, term, CAST(i AS INT) AS idx, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate - 1.959963984540054 * se, 4) AS ci_lower, round(estimate + 1.959963984540054 * se, 4) AS ci_upper, FALSE AS at_bound FROM p""")
def fit_continuous(spark: SparkSession, sf: str) -> DataFrame:
    """A continuous covariate leaves nothing to group: the gradient is an aggregate each iteration."""
    frame = population(spark, sf)
    df = prepare.standardised(frame.df, ["acctbal"])
    row = fit(CaptureFrame(df, frame.occasions, frame.names, frame.covariates), Spec("~acctbal", "~1", "~1"), local_rows=100)
    return rounded(parameters(spark.createDataFrame([row], FIT_SCHEMA)), 4)


@query("bootstrap_refits")
def bootstrap_refits(spark: SparkSession, sf: str) -> DataFrame:
    """Bias, corrected estimates, standard errors and intervals over refits, with the failures."""
    frame = population(spark, sf)
    estimates = spark.createDataFrame([fit(frame)], FIT_SCHEMA)
    reps = bootstrap(frame, replicates=40)
    return rounded(bootstrap_summary(reps, parameters(estimates)), 4)


@query("fit_covariance", f"""{_FIT}, {_TERMS}, {CONDITION}
SELECT a.param || '_(Intercept)' AS row, b.param || '_(Intercept)' AS col, round(info, 4) AS information, round(cov, 4) AS covariance,
 round(cov / sqrt((SELECT cov FROM cov v WHERE v.i = cov.i AND v.j = cov.i) * (SELECT cov FROM cov v WHERE v.i = cov.j AND v.j = cov.j)), 4) AS correlation, round(most / least, 4) AS condition, 'good' AS hessian
FROM cov JOIN k a ON cov.i = a.i JOIN k b ON cov.j = b.i, ev""")
def fit_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(covariance(population(spark, sf)), 4)


@query("prediction_from_fit", f"""{_FIT}, r AS (SELECT 1 / (1 + exp(-t0)) AS phi, 1 / (1 + exp(-t1)) AS p, exp(t2) AS f, ll FROM opt)
SELECT round(phi, 5) AS phi_mean, 0.0::DOUBLE AS phi_sd, round(p, 5) AS p_mean, 0.0::DOUBLE AS p_sd, round(f, 5) AS f_mean, 0.0::DOUBLE AS f_sd, round(ll, 4) AS log_likelihood, round(6 - 2 * ll, 4) AS aic,
 round(phi + f, 5) AS lambda_mean, round(phi + f, 5) AS lambda_median, 0.0::DOUBLE AS lambda_sd, round(phi + f, 5) AS lambda_least, round(phi + f, 5) AS lambda_most, round(phi + f, 5) AS lambda_q25, round(phi + f, 5) AS lambda_q75 FROM r""")
def prediction_from_fit(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted, each individual's rates and likelihood predicted from the fit, and their summary."""
    frame = population(spark, sf)
    row = fit(frame)
    out = prediction_summary(predicted(frame, row), row["n_parameters"])
    return out.select(*[F.round(c, 4 if c in ("log_likelihood", "aic") else 5).alias(c) for c in out.columns])


_BOTH = ((*_SEGMENT, "zbal"), ("1",), _SEGMENT)


@query("predictions_by_segment", f"""WITH RECURSIVE {OPEN}, zed AS (SELECT *, (acctbal - avg(acctbal) OVER ()) / stddev_samp(acctbal) OVER () AS zbal FROM ind), {newton_sql('zed', designs=_BOTH)},
q AS (SELECT x, e, l, segment, {', '.join(f'{r} AS {k}' for k, r in zip(('rs', 'rp', 'rf'), _rates(_BOTH)))} FROM (SELECT x, e, l, segment, zbal FROM zed), opt)
SELECT segment, count(*) AS n, round(avg(rs), 4) AS phi, round(avg(rp), 4) AS p, round(avg(rf), 4) AS f, round(avg(rs + rf), 4) AS lambda, round(sum({ll_sql('rs', 'rp', 'rf')}), 4) AS log_likelihood FROM q GROUP BY segment""")
def predictions_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a model with covariates, continuous ones too: means by segment."""
    frame = population(spark, sf)
    df = prepare.standardised(frame.df, ["acctbal"])
    frame = CaptureFrame(df, frame.occasions, frame.names, frame.covariates)
    rates = predicted(frame, fit(frame, Spec("~segment + acctbal", "~1", "~segment")))
    mean = [F.avg(c).alias(c) for c in ("phi", "p", "f", "lambda")]
    return rounded(rates.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), *mean, F.sum("log_likelihood").alias("log_likelihood")), 4)


@query("strategy_comparison")
def strategy_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(strategies_compared(population(spark, sf)), 3)


@query("fit_simulated")
def fit_simulated(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the fitted survival and detection are found again in histories simulated from them, as many as the population has."""
    frame = population(spark, sf)
    row = fit(frame)
    true = {q["param"]: q["estimate"] for q in row["params"]}
    rate = {k: 1 / (1 + math.exp(-true[k])) for k in ("phi", "p")}
    again = fit(simulated(spark, row["n"], frame.occasions, phi=rate["phi"], p=rate["p"], seed=42))
    rows = [(q["param"], true[q["param"]], q["estimate"], q["se"]) for q in again["params"] if q["param"] in rate]
    out = spark.createDataFrame(rows, "param string, simulated double, estimate double, se double")
    return rounded(out.withColumn("z", (F.col("estimate") - F.col("simulated")) / F.col("se")), 4)


@query("bootstrap_covariance")
def bootstrap_covariances(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bootstrap_covariance(bootstrap(population(spark, sf), replicates=40)), 5)


_BETA = "ln({phi}) + ln(1 - {phi}) + ln({p}) + ln(1 - {p})"
_KINDS = {
    "plain": {}, "ridge": {"ridge": 5.0, "free": (0, 5, 6)}, "barrier": {"prior": f"2.0 / (SELECT count(*) FROM ind) * ({_BETA})"}, "warm": {},
    "priors": {"prior": f"{_BETA} + 0.5 * (-0.5 * power((ln({{f}}) - ln(0.05::DOUBLE) - 0.5625) / 0.75, 2) - ln({{f}}) - ln(0.75::DOUBLE) - 0.5 * ln(2 * pi()))"},
}


def _penalised(kind: str) -> str:
    cells = ", ".join(f"('{a}', '{t}', {i})" for i, (a, t) in enumerate(_terms(_SPECS[1])))
    return f"SELECT '{kind}' AS kind, param, term, round([t0, t1, t2, t3, t4, t5, t6][i + 1], 4) AS estimate, round(ll, 4) AS log_likelihood FROM (VALUES {cells}) n(param, term, i), opt_{kind}"


@query("fit_penalised", f"WITH RECURSIVE {OPEN}, {', '.join(newton_sql(designs=_SPECS[1], name=f'_{k}', **how) for k, how in _KINDS.items())} {' UNION ALL '.join(map(_penalised, _KINDS))}")
def fit_penalised(spark: SparkSession, sf: str) -> DataFrame:
    """The segment model with a ridge, with priors, and from a warm start."""
    frame, spec = population(spark, sf), Spec("~segment", "~1", "~1")
    kinds = {"plain": {}, "ridge": {"penalty": Penalty(ridge=5.0)}, "priors": {"penalty": Penalty(beta=1.0, recruitment=0.5)}, "barrier": {"penalty": Penalty(barrier=2.0)}, "warm": {"warm_start": True, "strategy": "auto"}}
    rows = [(k, q["param"], q["term"], q["estimate"], r["log_likelihood"]) for k, how in kinds.items() for r in [fit(frame, spec, **how)] for q in r["params"]]
    return rounded(spark.createDataFrame(rows, "kind string, param string, term string, estimate double, log_likelihood double"), 4)


@query("fit_varying_levels")
def fit_varying_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Detection by a category that varies in time."""
    frame = population(spark, sf)
    df = frame.df.withColumn("tier", F.col("tier").cast("array<string>"))
    row = fit(CaptureFrame(df, frame.occasions, frame.names, frame.covariates), Spec("~1", "~tier", "~1"))
    return rounded(parameters(spark.createDataFrame([row], FIT_SCHEMA)).select("param", "term", "estimate"), 3)


_U42 = "((CAST('0x' || substr(md5('42-' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _left_out(i: int, fold: int, designs=None, columns: str = "segment") -> tuple[str, str]:
    """(CTEs of model i's fit without a fold, query of its likelihoods on both parts), from a CTE ``split`` with ``part``."""
    name, d = f"_{i}_{fold}", designs or _SPECS[i]
    ctes = f"tr{name} AS (SELECT * FROM split WHERE part <> {fold}), {newton_sql(f'tr{name}', designs=d, name=name)}"
    rates = ", ".join(f"{r} AS {k}" for k, r in zip(("rs", "rp", "rf"), _rates(d)))
    held = f"(SELECT x, e, l, t.*, {rates} FROM (SELECT x, e, l, {columns} FROM split WHERE part = {fold}), opt{name} t)"
    size = sum(map(len, d))
    return ctes, f"SELECT {i} AS model_id, {fold} AS fold, any_value(ll) AS train_ll, any_value(n) AS train_n, sum({ll_sql('rs', 'rp', 'rf')}) AS val_ll, count(*) AS val_n, {size} AS n_parameters FROM {held}"


def _folds_sql(split: str, folds: list[tuple[str, str]]) -> str:
    return f"""WITH RECURSIVE {OPEN}, split AS ({split}), {', '.join(c for c, _ in folds)},
r AS (SELECT model_id, val_ll / val_n AS v, train_ll / train_n AS t FROM ({' UNION ALL '.join(q for _, q in folds)})),
a AS (SELECT model_id, count(*) AS folds, avg(v) AS mean_ll, stddev_pop(v) AS sd_ll, avg(t) AS train_mean_ll FROM r GROUP BY model_id)
SELECT model_id, folds, round(mean_ll, 4) AS mean_ll, round(sd_ll, 4) AS sd_ll, round(train_mean_ll, 4) AS train_mean_ll, round(sd_ll / abs(mean_ll), 4) AS consistency,
 CASE WHEN sd_ll / abs(mean_ll) < 0.05 THEN 'consistent' WHEN sd_ll / abs(mean_ll) < 0.15 THEN 'moderate' ELSE 'inconsistent' END AS label FROM a"""


_ZED = "(acctbal - avg(acctbal) OVER ()) / stddev_samp(acctbal) OVER () AS zbal"
_FOLDS = [_left_out(i, j) for i in range(2) for j in range(5)]


@query("cross_validation", _folds_sql(f"SELECT *, CAST(floor({_U42} * 5) AS INT) AS part FROM ind", _FOLDS))
def cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Two models refitted without each of five folds and judged on it; consistency over folds."""
    rows = cross_validated(population(spark, sf), CANDIDATES[:2], k=5)
    return rounded(agree.fold_likelihoods(rows, ["model_id"]), 4)


@query("cross_validation_continuous", _folds_sql(f"SELECT *, CAST(floor({_U42} * 5) AS INT) AS part, {_ZED} FROM ind", [_left_out(i, j, d, "zbal") for i, d in enumerate((CONSTANT, _ZBAL)) for j in range(5)]))
def cross_validation_continuous(spark: SparkSession, sf: str) -> DataFrame:
    """Models with a continuous covariate: nothing to group, so all models and folds are fitted in step."""
    frame = population(spark, sf)
    df = prepare.standardised(frame.df, ["acctbal"])
    rows = cross_validated(CaptureFrame(df, frame.occasions, frame.names, frame.covariates), [Spec(), Spec("~acctbal")], k=5, local_rows=100)
    return rounded(agree.fold_likelihoods(rows, ["model_id"]), 4)


@query("fit_traces")
def fit_traces(spark: SparkSession, sf: str) -> DataFrame:
    """How the candidates' fits went: evaluations, objectives, improvement and the rate of convergence."""
    fits = spark.createDataFrame(fit_models(population(spark, sf), CANDIDATES).collect(), FIT_SCHEMA)  # a row a model, read twice
    trace = monitor.fit_traces(fits)
    out = monitor.sessions(trace).join(monitor.convergence_rate(trace), "session_id")
    return rounded(out.select("session_id", "evaluations", "first", "last", "best", "improvement", (F.col("rate") > 0).alias("converging")), 3)


_JUDGED = [_left_out(i, 0) for i in range(len(_SPECS))]


@query("model_selection", f"""WITH RECURSIVE {OPEN}, split AS (SELECT *, CAST({_U42} >= 0.2 AS INT) AS part FROM ind), {', '.join(c for c, _ in _JUDGED)},
r AS (SELECT *, 2.0::DOUBLE * n_parameters - 2 * train_ll AS aic, -val_ll / val_n AS loss, abs((train_ll / train_n - val_ll / val_n) / (train_ll / train_n)) AS over FROM ({' UNION ALL '.join(q for _, q in _JUDGED)}))
SELECT model_id, n_parameters, round(train_ll, 4) AS train_ll, round(val_ll, 4) AS val_ll, round(aic, 4) AS aic, CAST(row_number() OVER (ORDER BY aic, model_id) AS INT) AS ic_rank,
 round(exp(-(aic - (SELECT min(aic) FROM r)) / 2) / (SELECT sum(exp(-(aic - (SELECT min(aic) FROM r)) / 2)) FROM r), 4) AS weight, round(loss, 4) AS loss, CAST(row_number() OVER (ORDER BY loss, model_id) AS INT) AS loss_rank,
 round(over, 4) AS overfitting, CASE WHEN over < 0.05 THEN 'good' WHEN over < 0.15 THEN 'moderate' ELSE 'poor' END AS label FROM r""")
def model_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates fitted on a training part, judged on the rest and ranked both ways."""
    out = selection_workflow(population(spark, sf), CANDIDATES)
    return rounded(out.select("model_id", "n_parameters", "train_ll", "val_ll", "aic", "ic_rank", "weight", "loss", "loss_rank", "overfitting", "label"), 4)


@query("agreement_pipeline")
def agreement_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates fitted on two hash halves; parameters and models compared, and the whole put through the gate."""
    frame = population(spark, sf)
    fits = []
    for first in (True, False):
        half = frame.df.where((sampling.uniform(3, "id") < 0.5) == F.lit(first))
        rows = fit_models(CaptureFrame(half, frame.occasions, frame.names, frame.covariates), CANDIDATES).collect()  # a row a model
        fits.append(spark.createDataFrame(rows, FIT_SCHEMA))
    name = F.concat_ws("_", "param", F.lower(F.regexp_replace("term", r"[()]", "")))
    cmp = agree.compared(agree.paired(*[parameters(f).select(F.col("model_id").alias("model"), name.alias("param"), "estimate", "se") for f in fits], ["model", "param"]))
    side = lambda f, s: f.select(F.col("model_id").alias("model"), F.col("aic").alias(f"aic_{s}"), F.col("log_likelihood").alias(f"ll_{s}"), F.col("converged").alias(f"c_{s}"))
    models = agree.models_compared(side(fits[0], "a").join(side(fits[1], "b"), "model"), cmp)
    q = agree.quality_metrics(cmp).crossJoin(F.broadcast(models.agg(F.avg(F.col("status").isin("EXCELLENT", "GOOD", "ACCEPTABLE").cast("double")).alias("concordance"), F.avg((F.col("c_a") & F.col("c_b")).cast("double")).alias("reliability"))))  # one row each
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in (("parameter_accuracy", "accuracy_rate"), ("statistical_power", "equivalence_rate"), ("model_concordance", "concordance"), ("convergence_reliability", "reliability"))])
    gate = agree.gate(q.select(F.explode(rows).alias("r")).select("r.*"))
    simple = agree.simple_gate(cmp).withColumnRenamed("decision", "simple_decision")
    return rounded(gate.select("score", "risk", "decision").crossJoin(F.broadcast(simple)), 6)
