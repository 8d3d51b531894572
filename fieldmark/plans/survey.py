"""Sparse data, events as a second population, optimisation traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators import monitor, sampling, sparse
from fieldmark.operators.fit import Spec
from fieldmark.plans.base import CLOSED, OPEN, T, ordered, population, query, table
from fieldmark.plans.newton import newton_sql
from fieldmark.sources.histories import from_events, rounded

_UNIFORM = "((CAST('0x' || substr(md5('42-' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
_COUNTS = "count(*) AS n, count(*) FILTER (x = 0) AS never, count(*) FILTER (x = 1) AS once, count(*) FILTER (x = 2) AS twice, count(*) FILTER (x > 1) AS multiple, CAST(sum(x) AS BIGINT) AS captures"
_MONTHS = "mon AS (SELECT c_custkey AS id, count(DISTINCT month(o_orderdate)) FILTER (year(o_orderdate) = 1996) AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"


def monthly(spark, sf):
    """Customers by months of 1996: sparse, many never captured."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    o = ordered(spark, sf, 1996, 1996).select("o_custkey", F.month("o_orderdate").alias("m"))
    return from_events(c, o, "id", F.col("m"), list(range(1, 13)), "o_custkey").df


_SEVERITY = "CASE WHEN coverage < 0.30 OR sparse_pct > 50 THEN 'EXTREME' WHEN coverage < 0.55 OR sparse_pct > 25 THEN 'HIGH' WHEN coverage < 0.70 OR sparse_pct > 10 THEN 'MODERATE' ELSE 'LOW' END"
_SPARSE = f"""p AS (SELECT ch, count(*) AS k FROM ind GROUP BY ch),
s AS (SELECT {_COUNTS}, 7 AS occasions FROM ind),
g AS (SELECT count(*) AS patterns, min(k) AS least_count, 100.0::DOUBLE * count(*) FILTER (k <= 3) / count(*) AS sparse_pct FROM p),
q AS (SELECT *, captures::DOUBLE / (n * occasions) AS detection_rate, coalesce(multiple::DOUBLE / nullif(n - never, 0), 0) AS coverage FROM s, g)"""


@query("sparsity", f"WITH {OPEN}, {_SPARSE} SELECT n, never, once, multiple, patterns, least_count, round(sparse_pct, 6) AS sparse_pct, round(detection_rate, 6) AS detection_rate, round(coverage, 6) AS coverage, {_SEVERITY} AS severity FROM q")
def sparsity(spark, sf):
    out = sparse.sparsity(population(spark, sf).df, T)
    return rounded(out.select("n", "never", "once", "multiple", "patterns", "least_count", "sparse_pct", "detection_rate", "coverage", "severity"))


@query("sparsity_by_share", f"WITH {OPEN}, {_SPARSE}, r AS (SELECT count(*) FILTER (k <= greatest(5.0::DOUBLE, 0.01 * n)) AS rare, count(*) AS patterns, any_value(coverage) AS coverage FROM p, (SELECT n, coverage FROM q)) SELECT rare, patterns, round(coverage, 6) AS coverage, round(100.0::DOUBLE * rare / patterns, 6) AS rare_pct, CASE WHEN 100.0 * rare / patterns > 30 OR coverage < 0.55 THEN 'HIGH' WHEN 100.0 * rare / patterns > 15 OR coverage < 0.70 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM r")
def sparsity_by_share(spark, sf):
    return rounded(sparse.sparsity_by_share(population(spark, sf).df, T).select("rare", "patterns", "coverage", "rare_pct", "risk"))


_CHAO = """s AS (SELECT count(*) AS n, count(*) FILTER (x = 0) AS never, count(*) FILTER (x = 1)::DOUBLE AS n1, count(*) FILTER (x = 2)::DOUBLE AS n2, count(*) FILTER (x > 0)::DOUBLE AS seen,
 count(*) FILTER (x > 1)::DOUBLE AS multi, sum(x)::DOUBLE AS det FROM mon),
c AS (SELECT *, least(greatest(CASE WHEN n2 > 0 THEN 1 - n1 / (2 * n2) * n1 / seen ELSE 1 - n1 / seen END, 0), 1) AS c_hat FROM s),
v AS (SELECT *, CASE WHEN c_hat >= 0.55 THEN seen + CASE WHEN n2 > 0 THEN n1 * n1 / (2 * n2) ELSE n1 * (n1 - 1) / 2 END
 ELSE (seen + CASE WHEN n1 > 0 THEN seen + n1 * n1 / (2 * greatest(n2, 1)) ELSE 2 * seen END) / 2 END AS estimate,
 CASE WHEN c_hat >= 0.55 AND n2 > 0 THEN n1 * (n1 / 4 + n1 * n1 / (4 * n2) + n1 * n1 * n1 / (4 * n2 * n2)) END AS variance FROM c),
w AS (SELECT *, seen AS lower, least(CASE WHEN multi > 0 THEN n / greatest(0.1, multi / n) ELSE 3.0 * n END, CASE WHEN det > 0 THEN n / greatest(0.05, det / n / 12) ELSE 5.0 * n END, 10.0 * n) AS upper FROM v)"""


@query("coverage_estimate", f"WITH {_MONTHS}, {_CHAO} SELECT n, never, round(c_hat, 6) AS c_hat, round(estimate, 4) AS estimate, round(variance, 4) AS variance, round(CASE WHEN variance IS NOT NULL THEN greatest(seen, estimate - 1.96 * sqrt(variance)) ELSE greatest(seen, 0.7 * estimate) END, 4) AS ci_lower, round(CASE WHEN variance IS NOT NULL THEN estimate + 1.96 * sqrt(variance) ELSE 1.5 * estimate END, 4) AS ci_upper, CASE WHEN c_hat >= 0.75 THEN 'high' WHEN c_hat >= 0.55 THEN 'moderate' ELSE 'low' END AS reliability FROM v")
def coverage_estimate(spark, sf):
    out = sparse.coverage_estimate(sparse.counts(monthly(spark, sf), 12))
    return rounded(out.select("n", "never", F.round("c_hat", 6).alias("c_hat"), *[F.round(c, 4).alias(c) for c in ("estimate", "variance", "ci_lower", "ci_upper")], "reliability"))


@query("conservative_bounds", f"WITH {_MONTHS}, {_CHAO} SELECT round(lower, 4) AS lower, round(upper, 4) AS upper, round(sqrt(lower * upper), 4) AS point FROM w")
def conservative_bounds(spark, sf):
    return rounded(sparse.bounds(sparse.counts(monthly(spark, sf), 12)).select("lower", "upper", "point"), 4)


_MONTHLY = "mp AS (SELECT c_custkey AS id, " + " || ".join(f"CAST(coalesce(max(CASE WHEN year(o_orderdate) = 1996 AND month(o_orderdate) = {m} THEN 1 END), 0) AS VARCHAR)" for m in range(1, 13)) + " AS ch FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"


@query("sparse_consensus", f"""WITH {_MONTHS}, {_MONTHLY}, {_CHAO}, p AS (SELECT ch, count(*) AS k FROM mp GROUP BY ch), g AS (SELECT 100.0::DOUBLE * count(*) FILTER (k <= 3) / count(*) AS sparse_pct FROM p),
z AS (SELECT *, coalesce(multi / nullif(n - never, 0), 0) AS coverage FROM w, g), y AS (SELECT *, {_SEVERITY} AS severity FROM z)
SELECT severity, round(CASE WHEN severity = 'EXTREME' THEN (estimate + sqrt(lower * upper)) / 2 ELSE estimate END, 4) AS consensus, CASE WHEN severity = 'EXTREME' THEN 'multi_method_average' ELSE 'sample_coverage' END AS method FROM y""")
def sparse_consensus(spark, sf):
    return rounded(sparse.consensus(sparse.sparsity(monthly(spark, sf), 12)).select("severity", "consensus", "method"), 4)


@query("sparse_estimates", f"""WITH RECURSIVE {OPEN}, mon AS (SELECT * FROM ind), {_CHAO}, {_SPARSE.replace('s AS (', 'u AS (').replace('FROM s, g', 'FROM u, g')}, y AS (SELECT {_SEVERITY} AS severity FROM q),
{newton_sql(ridge=0.1)}, r AS (SELECT estimate, sqrt(lower * upper) AS point, seen / greatest(0.1, (exp(t0) + exp(t1) + exp(t2)) / 3) AS regularised, severity FROM w, opt, y)
SELECT severity, round(estimate, 3) AS estimate, round(point, 3) AS point, round(CASE WHEN severity IN ('HIGH', 'MODERATE') THEN regularised END, 3) AS regularised,
 round(CASE WHEN severity = 'EXTREME' THEN (estimate + point) / 2 WHEN severity IN ('HIGH', 'MODERATE') THEN (estimate + regularised) / 2 ELSE estimate END, 3) AS consensus,
 CASE WHEN severity = 'LOW' THEN 'sample_coverage' ELSE 'multi_method_average' END AS method FROM r""".replace("det / n / 12", "det / n / 7"))
def sparse_estimates(spark, sf):
    """The open population by every method that its sparsity calls for, a ridge fit among them."""
    out = sparse.estimated(population(spark, sf), Spec())
    return rounded(out.select("severity", "estimate", "point", "regularised", "consensus", "method"), 3)


@query("purchase_days", "WITH d AS (SELECT user_id AS id, count(DISTINCT date_trunc('day', ts)) AS x FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT CAST(x AS INT) AS x, count(*) AS n FROM d GROUP BY 1")
def purchase_days(spark, sf):
    """Users by days with a purchase: an occasion for each day of the event log."""
    ev = table(spark, sf, "events").select("user_id", "ts", "event_type")
    span = ev.agg(F.min(F.to_date("ts")).alias("d0"), F.max(F.to_date("ts")).alias("d1")).first()
    buys = ev.where("event_type = 'purchase'").withColumn("day", F.datediff(F.to_date("ts"), F.lit(span["d0"])))
    users = buys.select(F.col("user_id").alias("id")).distinct()
    return from_events(users, buys, "id", F.col("day"), list(range((span["d1"] - span["d0"]).days + 1)), "user_id").df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))


_ERRORS = "er AS (SELECT event_type AS category, CASE WHEN value IS NULL THEN 'low' WHEN value > 40 THEN 'high' ELSE 'medium' END AS severity, event_id % 3 = 0 AS recovered FROM events)"


@query("error_summary", f"WITH {_ERRORS} SELECT 'severity' AS kind, severity AS value, count(*) AS n, round(avg(CAST(recovered AS DOUBLE)), 6) AS recovery_rate FROM er GROUP BY 2 UNION ALL SELECT 'category', category, count(*), round(avg(CAST(recovered AS DOUBLE)), 6) FROM er GROUP BY 2")
def error_summary(spark, sf):
    """Events as errors, by severity and category."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("category"), F.when(F.col("value").isNull(), "low").when(F.col("value") > 40, "high").otherwise("medium").alias("severity"), (F.col("event_id") % 3 == 0).alias("recovered"))
    return rounded(monitor.error_summary(e))


@query("task_memory", "SELECT event_type AS worker, count(*) AS tasks, count(*) FILTER (coalesce(value, 0) > 20) AS successes, round(max(coalesce(value, 0)), 6) AS peak_mb FROM events GROUP BY 1")
def task_memory(spark, sf):
    """Events as tasks of workers: counts and the greatest memory."""
    v = F.coalesce("value", F.lit(0.0))
    t = table(spark, sf, "events").select(F.col("event_type").alias("worker"), (v > 20).alias("success"), v.alias("seconds"), v.alias("peak_mb"))
    return rounded(monitor.executions(t, "worker").select("worker", "tasks", "successes", "peak_mb"))


@query("sample_summary", f"WITH {OPEN}, s AS (SELECT *, t0 >= 2 AS st, {_UNIFORM} < 0.25 AS drawn FROM ind) SELECT count(*) AS n_original, round(avg(CAST(st AS DOUBLE)), 6) AS share_original, count(*) FILTER (drawn) AS n_sample, round(avg(CAST(st AS DOUBLE)) FILTER (drawn), 6) AS share_sample, round(count(*) FILTER (drawn) / count(*)::DOUBLE, 6) AS ratio FROM s")
def sample_summary(spark, sf):
    df = population(spark, sf).df
    return rounded(sampling.sample_summary(df, df.where(sampling.uniform(42, "id") < 0.25), F.element_at("tier", 1) >= 2))


@query("subset_by_ids", f"WITH {OPEN} SELECT id, ch FROM ind WHERE id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def subset_by_ids(spark, sf):
    ids = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))
    return sampling.subset(population(spark, sf).df.select("id", "ch"), ids)


_TRACE = "tr AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration, coalesce(value, 0) AS objective, abs(coalesce(value, 0)) / 10 AS grad_norm, event_type AS strategy, coalesce(value, 0) > 20 AS success FROM events)"


def traces(spark, sf):
    """Events as an optimiser's trace: users are sessions, their order iterations, values objectives."""
    from pyspark.sql import Window

    ev = table(spark, sf, "events")
    it = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    v = F.coalesce("value", F.lit(0.0))
    return ev.select(F.col("user_id").alias("session_id"), it.alias("iteration"), v.alias("objective"), (F.abs(v) / 10).alias("grad_norm"), F.col("event_type").alias("strategy"), (v > 20).alias("success"))


@query("trace_sessions", f"WITH {_TRACE} SELECT session_id, count(*) AS evaluations, round(arg_min(objective, iteration), 6) AS first, round(arg_max(objective, iteration), 6) AS last, round(min(objective), 6) AS best, round(max(objective), 6) AS worst, round(arg_min(objective, iteration) - arg_max(objective, iteration), 6) AS improvement, round(avg(grad_norm), 6) AS mean_grad_norm FROM tr GROUP BY 1")
def trace_sessions(spark, sf):
    return rounded(monitor.sessions(traces(spark, sf)).drop("best_at"))


@query("trace_convergence", f"WITH {_TRACE}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY iteration DESC) AS r FROM tr), q AS (SELECT *, ln(objective - min(objective) OVER (PARTITION BY session_id) + 1e-10) AS y FROM k WHERE r <= 10) SELECT session_id, round(-regr_slope(y, iteration), 6) AS rate, count(*) AS points FROM q GROUP BY 1")
def trace_convergence(spark, sf):
    return rounded(monitor.convergence_rate(traces(spark, sf)))


@query("trace_strategies", f"WITH {_TRACE} SELECT strategy, count(*) AS runs, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, round(avg(objective) FILTER (success), 6) AS mean, round(stddev_pop(objective) FILTER (success), 6) AS sd, round(min(objective) FILTER (success), 6) AS least FROM tr GROUP BY 1")
def trace_strategies(spark, sf):
    return rounded(monitor.strategies(traces(spark, sf)))


@query("trace_efficiency", f"WITH {_TRACE} SELECT session_id, round(least(100.0::DOUBLE, CASE WHEN count(*) > 1000 THEN 80.0::DOUBLE ELSE 100.0::DOUBLE END * CASE WHEN sum(grad_norm) > 3 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN bool_or(success) THEN 1.2::DOUBLE ELSE 0.3::DOUBLE END), 6) AS score FROM tr GROUP BY 1")
def trace_efficiency(spark, sf):
    s = traces(spark, sf).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("grad_norm").alias("s"), F.bool_or("success").alias("ok"))
    return rounded(s.select("session_id", monitor.efficiency(F.col("n"), F.col("s"), F.lit(3), F.col("ok")).alias("score")))


@query("execution_stats", f"WITH {_TRACE} SELECT strategy, count(*) AS tasks, count(*) FILTER (success) AS successes, round(sum(grad_norm), 4) AS total_s, round(avg(grad_norm), 6) AS mean_s, round(min(grad_norm), 6) AS min_s, round(max(grad_norm), 6) AS max_s FROM tr GROUP BY 1")
def execution_stats(spark, sf):
    out = monitor.executions(traces(spark, sf).withColumnRenamed("grad_norm", "seconds"), "strategy")
    return rounded(out.withColumn("total_s", F.round("total_s", 4)))


@query("error_types", f"WITH {_TRACE} SELECT strategy AS error_type, count(*) AS n, round(avg(CAST(success AS DOUBLE)), 6) AS recovery_rate FROM tr GROUP BY 1 ORDER BY n DESC, error_type LIMIT 5")
def error_types(spark, sf):
    return rounded(monitor.error_types(traces(spark, sf).select(F.col("strategy").alias("error_type"), F.col("success").alias("recovered"))))


_ZEROS, _RATIO = "(1 - sum(x)::DOUBLE / (count(*) * 7))", "(3.0::DOUBLE / count(*))"


@query("problem_difficulty", f"""WITH {OPEN}, d AS (SELECT segment, round({_ZEROS}, 6) AS sparsity,
 CASE WHEN {_RATIO} > 0.1 THEN 3 WHEN {_RATIO} > 0.05 THEN 2 WHEN {_RATIO} > 0.02 THEN 1 ELSE 0 END + CASE WHEN {_ZEROS} > 0.9 THEN 2 WHEN {_ZEROS} > 0.8 THEN 1 ELSE 0 END + 1 AS score FROM ind GROUP BY 1)
SELECT segment, sparsity, CASE WHEN score >= 6 THEN 'very_difficult' WHEN score >= 4 THEN 'difficult' WHEN score >= 2 THEN 'moderate' ELSE 'easy' END AS difficulty FROM d""")
def problem_difficulty(spark, sf):
    g = population(spark, sf).df.groupBy("segment").agg((1 - F.sum("x") / (F.count(F.lit(1)) * 7).cast("double")).alias("sparsity"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("segment", "sparsity", monitor.difficulty(F.lit(3.0) / F.col("n"), F.col("sparsity"), F.lit(T), F.lit(3)).alias("difficulty")))


@query("closed_sparsity", f"WITH {CLOSED}, {_SPARSE} SELECT n, never, patterns, round(coverage, 6) AS coverage, {_SEVERITY} AS severity FROM q")
def closed_sparsity(spark, sf):
    return rounded(sparse.sparsity(population(spark, sf, "closed").df, T).select("n", "never", "patterns", "coverage", "severity"))
