"""Two sets of estimates from the tables: per nation, all customers against a hash half of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import agree, monitor, sampling
from fieldmark.plans.base import query, t_sf_sql, table
from fieldmark.sources.histories import rounded

_HALF = "((CAST('0x' || substr(md5('11-' || c_custkey), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) < 0.5"
_EST = "avg(c_acctbal) / 1000 AS estimate, stddev_samp(c_acctbal) / sqrt(count(*)) / 1000 AS se"
_NAME = "CASE WHEN c_nationkey % 5 = 0 THEN 'phi_intercept' WHEN c_nationkey % 5 = 1 THEN 'p_intercept' WHEN c_nationkey % 5 = 2 THEN 'f_age' WHEN c_nationkey % 5 = 3 THEN 'phi_sex' ELSE 'tau' END || '_' || c_nationkey"
_PAIRS = f"""ea AS (SELECT {_NAME} AS param, {_EST} FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey),
eb AS (SELECT {_NAME} AS param, {_EST} FROM customer WHERE {_HALF} AND c_nationkey <> 8 GROUP BY c_nationkey),
pr AS (SELECT param, ea.estimate AS a, ea.se AS s1, eb.estimate AS b, eb.se AS s2 FROM ea JOIN eb USING (param) WHERE ea.se IS NOT NULL AND eb.se IS NOT NULL)"""


def sides(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_nationkey") % 5
    name = F.concat_ws("_", F.when(k == 0, "phi_intercept").when(k == 1, "p_intercept").when(k == 2, "f_age").when(k == 3, "phi_sex").otherwise("tau"), F.col("c_nationkey"))
    est = [(F.avg("c_acctbal") / 1000).alias("estimate"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count(F.lit(1))) / 1000).alias("se")]
    a = c.where("c_nationkey <> 3").groupBy(name.alias("param")).agg(*est)
    b = c.where((sampling.uniform(11, "c_custkey") < 0.5) & (F.col("c_nationkey") != 8)).groupBy(name.alias("param")).agg(*est)
    return a, b


def pairs(spark, sf):
    return agree.paired(*sides(spark, sf), ["param"]).where("se_a is not null and se_b is not null")


@query("estimate_pairs", f"WITH {_PAIRS} SELECT param, round(a, 6) AS est_a, round(s1, 6) AS se_a, round(b, 6) AS est_b, round(s2, 6) AS se_b FROM pr")
def estimate_pairs(spark, sf):
    return rounded(pairs(spark, sf))


@query("unmatched_estimates", f"WITH {_PAIRS} SELECT param, 'a' AS side FROM ea WHERE param NOT IN (SELECT param FROM eb) UNION ALL SELECT param, 'b' FROM eb WHERE param NOT IN (SELECT param FROM ea)")
def unmatched_estimates(spark, sf):
    return agree.unmatched(*sides(spark, sf), ["param"])


_REL = "CASE WHEN abs(b) > 1e-10 THEN 100 * abs(a - b) / abs(b) ELSE 0 END"
_STATUS = f"CASE WHEN {_REL} < 0.1 THEN 'EXCELLENT' WHEN {_REL} < 1 THEN 'GOOD' WHEN {_REL} < 5 THEN 'ACCEPTABLE' WHEN {_REL} < 20 THEN 'POOR' ELSE 'FAILED' END"
_Z = "1.959963984540054"
_OV = "least(a + {t} * s1, b + {t} * s2) - greatest(a - {t} * s1, b - {t} * s2)"
_OVZ = _OV.format(t=_Z)
_CMP = f"""cm AS (SELECT *, CASE WHEN split_part(param, '_', 1) IN ('phi', 'p', 'f') THEN split_part(param, '_', 1) ELSE 'other' END AS param_type, abs(a - b) AS abs_diff, {_REL} AS rel_pct,
 abs(a - b) / sqrt((s1 * s1 + s2 * s2) / 2) AS std_diff, {_OVZ} >= 0 AS ci_overlap, greatest({_OVZ}, 0) / ({_Z} * (s1 + s2)) AS overlap_prop, {_STATUS} AS status FROM pr)"""


@query("parameter_comparison", f"WITH {_PAIRS}, {_CMP} SELECT param, param_type, round(abs_diff, 6) AS abs_diff, round(rel_pct, 5) AS rel_pct, round(std_diff, 6) AS std_diff, ci_overlap, round(overlap_prop, 6) AS overlap_prop, status FROM cm")
def parameter_comparison(spark, sf):
    c = agree.compared(pairs(spark, sf))
    return rounded(c.withColumn("rel_pct", F.round("rel_pct", 5)).select("param", "param_type", "abs_diff", "rel_pct", "std_diff", "ci_overlap", "overlap_prop", "status"))


_OK = "CAST(status IN ('EXCELLENT', 'GOOD', 'ACCEPTABLE') AS DOUBLE)"
_SUM = f"count(*) AS n, round(avg(abs_diff), 6) AS mean_abs, round(median(abs_diff), 6) AS median_abs, round(max(abs_diff), 6) AS max_abs, round(avg(rel_pct), 5) AS mean_rel, round(avg(CAST(ci_overlap AS DOUBLE)), 6) AS overlap_rate, round(avg({_OK}), 6) AS pass_rate"
_SUMCOLS = ("n", "mean_abs", "median_abs", "max_abs", "mean_rel", "overlap_rate", "pass_rate")


def _summary(df):
    return rounded(df.withColumn("mean_rel", F.round("mean_rel", 5)))


@query("comparison_summary", f"WITH {_PAIRS}, {_CMP} SELECT {_SUM} FROM cm")
def comparison_summary(spark, sf):
    return _summary(agree.comparison_summary(agree.compared(pairs(spark, sf))).select(*_SUMCOLS))


@query("comparison_by_type", f"WITH {_PAIRS}, {_CMP} SELECT param_type, {_SUM} FROM cm GROUP BY 1")
def comparison_by_type(spark, sf):
    return _summary(agree.comparison_summary(agree.compared(pairs(spark, sf)), ["param_type"]).select("param_type", *_SUMCOLS))


@query("comparison_critical", f"WITH {_PAIRS}, {_CMP} SELECT {_SUM} FROM cm WHERE param LIKE '%intercept%'")
def comparison_critical(spark, sf):
    return _summary(agree.comparison_summary(agree.critical(agree.compared(pairs(spark, sf)))).select(*_SUMCOLS))


@query("equivalence_tests", f"WITH {_PAIRS} SELECT param, round(a - b, 6) AS diff, round(0.05 * greatest(abs(a), abs(b), 1), 6) AS bound, round(((a - b) + 0.05 * greatest(abs(a), abs(b), 1)) / sqrt(s1 * s1 + s2 * s2), 5) AS t_lower, round((0.05 * greatest(abs(a), abs(b), 1) - (a - b)) / sqrt(s1 * s1 + s2 * s2), 5) AS t_upper, CAST(greatest(1, trunc(power(s1 * s1 + s2 * s2, 2) / (power(s1, 4) + power(s2, 4)))) AS INT) AS df FROM pr")
def equivalence_tests(spark, sf):
    e = agree.equivalence(pairs(spark, sf))
    return e.select("param", F.round("diff", 6).alias("diff"), F.round("bound", 6).alias("bound"), F.round("t_lower", 5).alias("t_lower"), F.round("t_upper", 5).alias("t_upper"), "df")


_TOST = """e AS (SELECT param, a - b AS d, 0.05 * greatest(abs(a), abs(b), 1) AS m, sqrt(s1 * s1 + s2 * s2) AS s,
 greatest(1, trunc(power(s1 * s1 + s2 * s2, 2) / (power(s1, 4) + power(s2, 4)))) AS df FROM pr),
u AS (SELECT param, (d + m) / s AS lo, (m - d) / s AS hi, df FROM e)"""


@query("equivalence_decisions", f"""WITH {_PAIRS}, {_TOST}, p AS (SELECT param, greatest({t_sf_sql('lo', 'df')}, {t_sf_sql('hi', 'df')}) AS p FROM u)
SELECT param, round(p, 6) AS p, CASE WHEN p < 0.05 THEN 'EQUIVALENT' ELSE 'NOT_EQUIVALENT' END AS status FROM p""")
def equivalence_decisions(spark, sf):
    """Two one-sided t tests with p values of the t distribution, and their verdicts."""
    return rounded(agree.equivalence(pairs(spark, sf), with_p=True).select("param", "p", "status"))


_OV1 = _OV.format(t="12.706204736432095")


@query("interval_overlap", f"WITH {_PAIRS} SELECT param, round(greatest({_OV1}, 0) / (12.706204736432095 * (s1 + s2)), 6) AS overlap, round(greatest(-({_OV1}), 0), 6) AS gap, CASE WHEN {_OV1} < 0 THEN 'NOT_EQUIVALENT' WHEN greatest({_OV1}, 0) / (12.706204736432095 * (s1 + s2)) > 0.5 THEN 'EQUIVALENT' ELSE 'INCONCLUSIVE' END AS status FROM pr")
def interval_overlap(spark, sf):
    return rounded(agree.interval_overlap(pairs(spark, sf)).select("param", "overlap", "gap", "status"))


@query("concordance", f"WITH {_PAIRS}, d AS (SELECT *, a - b AS d, (a + b) / 2 AS m FROM pr) SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(2 * covar_samp(a, b) / (var_samp(a) + var_samp(b) + power(avg(a) - avg(b), 2)), 6) AS ccc, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(d), 6) AS bias, round(avg(d) - 2.07 * stddev_samp(d), 6) AS loa_lower, round(avg(d) + 2.07 * stddev_samp(d), 6) AS loa_upper, round(abs(corr(m, d)), 6) AS proportional_bias, round(median(d), 6) AS median_diff, round((SELECT median(abs(d - (SELECT median(d) FROM d))) FROM d), 6) AS mad, (SELECT count(*) FROM d WHERE abs(0.6745 * (d - (SELECT median(d) FROM d)) / (SELECT median(abs(d - (SELECT median(d) FROM d))) FROM d)) > 3.5) AS outliers FROM d")
def concordance(spark, sf):
    one = agree.concordance(pairs(spark, sf), t=2.07)
    return rounded(one.select("n", "r", "ccc", "mae", "rmse", "bias", "loa_lower", "loa_upper", "proportional_bias", "median_diff", "mad", "outliers"))


@query("rank_agreement", f"""WITH {_PAIRS}, q AS (SELECT x.param, sign(x.a - y.a) * sign(x.b - y.b) AS s FROM pr x JOIN pr y ON x.param < y.param),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM pr)
SELECT count(*) AS pairs, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant, round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0))::DOUBLE / count(*), 6) AS tau_a, round((SELECT corr(ra, rb) FROM r), 6) AS rho, round((SELECT avg(CAST(ra = rb AS DOUBLE)) FROM r), 6) AS exact FROM q""")
def rank_agreement(spark, sf):
    return rounded(agree.rank_agreement(pairs(spark, sf), "est_a", "est_b").select("pairs", "concordant", "discordant", "tau_a", "rho", "exact"))


@query("outlier_flags", f"WITH {_PAIRS}, d AS (SELECT param, a - b AS d FROM pr), m AS (SELECT median(d) AS md FROM d), v AS (SELECT median(abs(d - md)) AS mad FROM d, m) SELECT param, coalesce(abs(0.6745 * (d - md) / nullif(mad, 0)) > 3.5, false) AS outlier FROM d, m, v")
def outlier_flags(spark, sf):
    d = pairs(spark, sf).select("param", (F.col("est_a") - F.col("est_b")).alias("d"))
    return agree.outliers(d, "d").select("param", "outlier")


@query("effect_sizes", f"WITH {_PAIRS}, e AS (SELECT param, abs(a - b) / sqrt(s1 * s1 + s2 * s2) AS d FROM pr) SELECT param, round(d, 6) AS effect, CASE WHEN d < 0.2 THEN 'negligible' WHEN d < 0.5 THEN 'small' WHEN d < 0.8 THEN 'medium' ELSE 'large' END AS label FROM e")
def effect_sizes(spark, sf):
    e = agree.equivalence(pairs(spark, sf)).withColumn("effect", F.abs("effect"))
    return rounded(e.select("param", "effect", agree.effect_label(F.col("effect")).alias("label")))


@query("quality_metrics", f"WITH {_PAIRS}, {_CMP} SELECT round(avg({_OK}), 6) AS accuracy_rate, round(avg(CAST(ci_overlap AS DOUBLE)), 6) AS equivalence_rate, round(avg(rel_pct) FILTER (rel_pct > 0), 5) AS mean_rel, round(max(rel_pct) FILTER (rel_pct > 0), 5) AS max_rel FROM cm")
def quality_metrics(spark, sf):
    q = agree.quality_metrics(agree.compared(pairs(spark, sf)))
    return rounded(q.withColumns({"mean_rel": F.round("mean_rel", 5), "max_rel": F.round("max_rel", 5)}))


@query("quality_gate", f"""WITH {_PAIRS}, {_CMP}, v AS (SELECT avg(CAST(ci_overlap AS DOUBLE)) AS v1, avg({_OK}) AS v2 FROM cm),
m AS (SELECT 'parameter' AS component, (v1 * 2 + 0.97 * 1) / 3 AS score, CAST(v1 < 0.9 AS INT) AS poor FROM v UNION ALL SELECT 'model', (0.96 * 1.5 + 0.99 * 1.8) / 3.3, 0 UNION ALL SELECT 'system', (0.97 * 1 + 0.9 * 0.5) / 1.5, 0),
s AS (SELECT sum(score * CASE component WHEN 'parameter' THEN 0.5 WHEN 'model' THEN 0.3 ELSE 0.2 END) AS score, sum(poor) AS poor FROM m)
SELECT round(score, 6) AS score, CAST(poor AS BIGINT) AS poor_components, CASE WHEN poor >= 2 THEN 'CRITICAL' WHEN poor = 1 THEN 'HIGH' WHEN score < 0.9 THEN 'MODERATE' ELSE 'LOW' END AS risk, CASE WHEN poor >= 1 THEN 'MANUAL_REVIEW' WHEN score >= 0.9 THEN 'APPROVED' WHEN score >= 0.75 THEN 'APPROVED_WITH_WARNINGS' ELSE 'MANUAL_REVIEW' END AS decision FROM s""")
def quality_gate(spark, sf):
    q = agree.quality_metrics(agree.compared(pairs(spark, sf)))
    given = {"statistical_power": 0.97, "model_concordance": 0.96, "convergence_reliability": 0.99, "system_stability": 0.97, "performance_efficiency": 0.9}
    rows = [F.struct(F.lit("parameter_accuracy").alias("metric"), F.col("equivalence_rate").alias("value"))] + [F.struct(F.lit(k).alias("metric"), F.lit(v).alias("value")) for k, v in given.items()]
    metrics = q.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return rounded(agree.gate(metrics).select("score", "poor_components", "risk", "decision"))


@query("simple_gate", f"WITH {_PAIRS}, {_CMP}, s AS (SELECT avg({_OK}) AS pass_rate, count(*) FILTER (status IN ('POOR', 'FAILED') AND param LIKE '%intercept%') AS critical_failures FROM cm) SELECT round(pass_rate, 6) AS pass_rate, critical_failures, CASE WHEN critical_failures > 0 THEN 'REJECTED' WHEN pass_rate >= 0.9 THEN 'APPROVED' WHEN pass_rate >= 0.75 THEN 'APPROVED_WITH_WARNINGS' ELSE 'MANUAL_REVIEW' END AS decision FROM s")
def simple_gate(spark, sf):
    return rounded(agree.simple_gate(agree.compared(pairs(spark, sf))))


@query("regression_gate", f"WITH {_PAIRS}, j AS (SELECT ea.param, ea.estimate AS was, eb.estimate AS now FROM ea LEFT JOIN eb USING (param)) SELECT param, round(abs(now - was), 6) AS abs_diff, coalesce(abs(now - was) <= 1e-6 OR abs(now - was) / abs(was) <= 0.05, false) AS passed FROM j")
def regression_gate(spark, sf):
    a, b = sides(spark, sf)
    return rounded(monitor.regression_gate(a, b, "param", "estimate", rel=0.05).select("param", "abs_diff", "passed"))


@query("fold_stability", "WITH q AS (SELECT c_mktsegment AS param, c_nationkey AS fold, avg(c_acctbal) AS value FROM customer GROUP BY 1, 2) SELECT param, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, CASE WHEN stddev_samp(value) / abs(avg(value)) < 0.01 THEN 'very_stable' WHEN stddev_samp(value) / abs(avg(value)) < 0.05 THEN 'stable' WHEN stddev_samp(value) / abs(avg(value)) < 0.2 THEN 'moderate' ELSE 'unstable' END AS stability FROM q GROUP BY 1")
def fold_stability(spark, sf):
    q = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("param"), "c_nationkey").agg(F.avg("c_acctbal").alias("value"))
    return rounded(agree.fold_stability(q).drop("cv"), 4)


@query("model_agreement", f"""WITH {_PAIRS}, {_CMP}, g AS (SELECT CAST(regexp_extract(param, '([0-9]+)$', 1) AS INT) % 4 AS model, * FROM cm),
r AS (SELECT model, avg({_OK}) AS pass_rate, coalesce(avg({_OK}) FILTER (param LIKE '%intercept%'), 1) AS critical_rate, abs(sum(a) - sum(b)) AS aic_diff, 100 * abs(sum(a) - sum(b)) / abs(sum(b)) AS ll_pct FROM g GROUP BY 1)
SELECT model, round(pass_rate, 6) AS pass_rate, round(critical_rate, 6) AS critical_rate, round(aic_diff, 6) AS aic_diff, round(ll_pct, 5) AS ll_pct, CASE WHEN aic_diff < 2 AND ll_pct < 1 AND pass_rate >= 0.8 AND critical_rate >= 0.9 THEN 'EXCELLENT' WHEN (aic_diff < 2 OR ll_pct < 1) AND pass_rate >= 0.8 THEN 'GOOD' WHEN pass_rate >= 0.8 AND critical_rate >= 0.9 THEN 'ACCEPTABLE' WHEN pass_rate >= 0.8 OR critical_rate >= 0.9 THEN 'POOR' ELSE 'FAILED' END AS status FROM r""")
def model_agreement(spark, sf):
    c = agree.compared(pairs(spark, sf)).withColumn("model", F.regexp_extract("param", "([0-9]+)$", 1).cast("int") % 4)
    m = c.groupBy("model").agg(F.sum("est_a").alias("aic_a"), F.sum("est_b").alias("aic_b"), F.sum("est_a").alias("ll_a"), F.sum("est_b").alias("ll_b"))
    out = agree.models_compared(m, c).select("model", "pass_rate", "critical_rate", "aic_diff", F.round("ll_pct", 5).alias("ll_pct"), "status")
    return rounded(out)


@query("resume_models", "WITH done AS (SELECT s_nationkey AS model_id FROM supplier GROUP BY 1 HAVING count(*) % 2 = 0) SELECT n_nationkey AS model_id FROM nation WHERE n_nationkey NOT IN (SELECT model_id FROM done)")
def resume_models(spark, sf):
    """Models without a stored fit; nations with an even number of suppliers stand for those that have one."""
    done = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("model_id")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0").select("model_id")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("model_id")).join(done, "model_id", "left_anti")


@query("formula_grid", """WITH k AS (SELECT count(DISTINCT c_mktsegment) - 1 AS k FROM customer)
SELECT CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS INT) AS model_id, a AS phi, b AS p, c AS f, CAST(3 + CASE WHEN a = '~segment' THEN k ELSE 0 END + CASE WHEN b = '~segment' THEN k ELSE 0 END + CASE WHEN c = '~acctbal' THEN 1 ELSE 0 END AS INT) AS n_parameters
FROM (VALUES ('~1'), ('~segment')) x(a), (VALUES ('~1'), ('~segment')) y(b), (VALUES ('~1'), ('~acctbal')) z(c), k""")
def formula_grid(spark, sf):
    """A grid of candidate models and how many coefficients each has on the data, whose levels make the columns."""
    from fieldmark.operators.fit import coefficients
    from fieldmark.operators.fit import formula_grid as grid
    from fieldmark.plans.base import population

    return coefficients(population(spark, sf), grid(["~1", "~segment"], ["~1", "~segment"], ["~1", "~acctbal"]))


@query("tasks_by_dataset", "SELECT r_name AS dataset, n_nationkey AS model_id FROM region, nation")
def tasks_by_dataset(spark, sf):
    """Every model on every data set (both few)."""
    return table(spark, sf, "region").select(F.col("r_name").alias("dataset")).crossJoin(table(spark, sf, "nation").select(F.col("n_nationkey").alias("model_id")))


@query("simple_equivalence", f"WITH {_PAIRS}, e AS (SELECT param, abs(a - b) / abs(b) AS r FROM pr) SELECT param, round(r, 6) AS rel_diff, r <= 0.05 AS equivalent FROM e")
def simple_equivalence(spark, sf):
    return rounded(agree.simple_equivalence(pairs(spark, sf)).select("param", "rel_diff", "equivalent"))


@query("publication_summary", f"""WITH {_PAIRS}, {_CMP}, t AS (
 SELECT 'overall' AS section, {_SUM} FROM cm UNION ALL SELECT 'type: ' || param_type, {_SUM} FROM cm GROUP BY param_type UNION ALL SELECT 'critical', {_SUM} FROM cm WHERE param LIKE '%intercept%')
SELECT section, 'n' AS metric, n::DOUBLE AS value, CAST(NULL AS VARCHAR) AS note FROM t UNION ALL SELECT section, 'mean_abs', mean_abs, NULL FROM t UNION ALL SELECT section, 'pass_rate', pass_rate, NULL FROM t
UNION ALL SELECT 'conclusion', 'pass_rate', pass_rate, CASE WHEN pass_rate >= 0.9 THEN 'excellent' WHEN pass_rate >= 0.8 THEN 'good' WHEN pass_rate >= 0.7 THEN 'acceptable' ELSE 'poor' END FROM t WHERE section = 'overall'""")
def publication_summary(spark, sf):
    return rounded(agree.publication_summary(agree.compared(pairs(spark, sf))).where("metric in ('n', 'mean_abs', 'pass_rate')"))


@query("convergence_agreement", f"WITH {_PAIRS}, j AS (SELECT s1 < 0.6 AS ca, s2 < 0.6 AS cb FROM pr) SELECT count(*) AS models, count(*) FILTER (ca AND cb) AS both, count(*) FILTER (ca <> cb) AS one, count(*) FILTER (NOT ca AND NOT cb) AS neither, round(avg(CAST(ca = cb AS DOUBLE)), 6) AS agreement FROM j")
def convergence_agreement(spark, sf):
    """Fits of both sides that converged; here those with a small standard error."""
    p = pairs(spark, sf)
    a, b = (p.select("param", (F.col(f"se_{s}") < 0.6).alias("converged")) for s in "ab")
    return rounded(agree.convergence_agreement(a, b, ["param"]))


@query("status_categories", f"WITH {_PAIRS}, {_CMP} SELECT status AS category, count(*) AS n, round(count(*) / (SELECT count(*) FROM cm)::DOUBLE, 6) AS share FROM cm GROUP BY 1")
def status_categories(spark, sf):
    return rounded(agree.categories(agree.compared(pairs(spark, sf)), "status"))


@query("stacked_results", f"WITH {_PAIRS} SELECT 'all' AS dataset, param, round(estimate, 6) AS estimate FROM ea UNION ALL SELECT 'half', param, round(estimate, 6) FROM eb")
def stacked_results(spark, sf):
    a, b = sides(spark, sf)
    return rounded(agree.stacked({"all": a.select("param", "estimate"), "half": b.select("param", "estimate")}))


@query("fold_metrics", """WITH f AS (SELECT c_mktsegment AS param, c_nationkey AS fold, avg(c_acctbal) AS v, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT c_mktsegment AS param, avg(c_acctbal) AS m FROM customer GROUP BY 1),
d AS (SELECT param, abs(v - m) AS abs_diff, 100 * abs(v - m) / abs(m) AS rel_pct, n > 1 AS converged FROM f JOIN m USING (param)),
g AS (SELECT param, count(*) AS n, avg(abs_diff) AS mean_abs, stddev_pop(abs_diff) AS sd_abs, avg(rel_pct) AS mean_rel, stddev_pop(rel_pct) AS sd_rel, avg(CAST(converged AS DOUBLE)) AS convergence_rate FROM d GROUP BY 1)
SELECT param, n, round(mean_abs, 4) AS mean_abs, round(sd_abs, 4) AS sd_abs, round(mean_rel, 4) AS mean_rel, round(sd_rel, 4) AS sd_rel, round(convergence_rate, 4) AS convergence_rate,
 CASE WHEN sd_rel / abs(mean_rel) < 0.01 THEN 'very_stable' WHEN sd_rel / abs(mean_rel) < 0.05 THEN 'stable' WHEN sd_rel / abs(mean_rel) < 0.2 THEN 'moderate' ELSE 'unstable' END AS stability FROM g""")
def fold_metrics(spark, sf):
    """Differences of each fold's estimate from the whole's."""
    c = table(spark, sf, "customer")
    f = c.groupBy(F.col("c_mktsegment").alias("param"), F.col("c_nationkey").alias("fold")).agg(F.avg("c_acctbal").alias("v"), (F.count(F.lit(1)) > 1).alias("converged"))
    m = c.groupBy(F.col("c_mktsegment").alias("param")).agg(F.avg("c_acctbal").alias("m"))
    d = f.join(m, "param").withColumns({"abs_diff": F.abs(F.col("v") - F.col("m")), "rel_pct": 100.0 * F.abs(F.col("v") - F.col("m")) / F.abs("m")})
    return rounded(agree.fold_metrics(d), 4)


@query("likelihood_gate", f"WITH {_PAIRS} SELECT param, round(abs(eb.estimate - ea.estimate), 6) AS ll_diff, abs(eb.estimate - ea.estimate) > 0.5 AS warning FROM ea JOIN eb USING (param)")
def likelihood_gate(spark, sf):
    a, b = (x.select("param", F.col("estimate").alias("log_likelihood")) for x in sides(spark, sf))
    return rounded(monitor.likelihood_gate(a, b, "param", tol=0.05))


@query("performance_gate", """WITH g AS (SELECT c_nationkey % 5 AS task, avg(abs(c_acctbal)) AS a, avg(CAST(c_acctbal > 0 AS DOUBLE)) AS r, avg(abs(c_acctbal)) FILTER (c_custkey % 2 = 0) AS a2, avg(CAST(c_acctbal > 0 AS DOUBLE)) FILTER (c_custkey % 2 = 0) AS r2 FROM customer GROUP BY 1)
SELECT task, round(a2 / a, 6) AS ratio, round(r2 / r, 6) AS success_ratio, a2 / a <= 1.05 AND r2 >= 0.97 * r AS passed FROM g""")
def performance_gate(spark, sf):
    """Times and successes of a run against a baseline; balances stand for seconds."""
    c = table(spark, sf, "customer").withColumn("task", F.col("c_nationkey") % 5)
    of = lambda df: df.groupBy("task").agg(F.avg(F.abs("c_acctbal")).alias("seconds"), F.avg((F.col("c_acctbal") > 0).cast("double")).alias("success_rate"))
    return rounded(monitor.performance_gate(of(c), of(c.where("c_custkey % 2 = 0")), "task", 1.05, 0.97))


@query("difference_jackknife", f"""WITH {_PAIRS}, d AS (SELECT a - b AS d FROM pr), j AS (SELECT (sum(d) OVER () - d) / (count(*) OVER () - 1) AS m, d FROM d), c AS (SELECT *, avg(m) OVER () - m AS u FROM j)
SELECT count(*) AS n, round(avg(d), 6) AS observed, round(sqrt((count(*) - 1) * sum(u * u) / count(*)), 6) AS se, round(sum(u * u * u) / (6 * power(sum(u * u), 1.5)), 6) AS acceleration FROM c""")
def difference_jackknife(spark, sf):
    """The mean difference's standard error and acceleration with each pair left out."""
    return rounded(agree.jackknife(pairs(spark, sf)))


@query("difference_intervals")
def difference_intervals(spark, sf):
    """Bootstrap intervals of the mean difference, with the bias-corrected accelerated one."""
    return rounded(agree.difference_intervals(pairs(spark, sf), replicates=400))
