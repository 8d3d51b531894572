"""Histories, recodes, imputation, validation, statistics: queries with exact SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions import links
from fieldmark.functions.formula import describe, design, parse
from fieldmark.operators import prepare, sampling, validate
from fieldmark.operators.suffstat import compressed, empirical, runs
from fieldmark.plans.base import CLOSED, OPEN, T, YEARS, ll_sql, population, query, table
from fieldmark.sources.histories import from_strings, from_wide, rounded


def r6(df: DataFrame) -> DataFrame:
    return rounded(df, 6)


@query("history_from_events", f"WITH {OPEN} SELECT id, ch, CAST(x AS INT) AS x, CAST(e AS INT) AS e, CAST(l AS INT) AS l FROM ind")
def history_from_events(spark, sf):
    return population(spark, sf).df.select("id", "ch", "x", "e", "l")


@query("history_closed", f"WITH {CLOSED} SELECT x, CAST(count(*) AS BIGINT) AS n FROM ind GROUP BY x")
def history_closed(spark, sf):
    return population(spark, sf, "closed").df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))


@query("history_from_strings", f"WITH {OPEN} SELECT id, CAST(x AS INT) AS x, CAST(e AS INT) AS e, CAST(l AS INT) AS l, segment FROM ind")
def history_from_strings(spark, sf):
    """The encounter-string adapter on the histories as text."""
    df = population(spark, sf).df.select("id", "ch", "segment")
    return from_strings(df, id_col="id").df.select("id", "x", "e", "l", "segment")


@query("history_from_wide", f"WITH {OPEN} SELECT id, CAST(x AS INT) AS x, CAST(e AS INT) AS e, CAST(l AS INT) AS l, round(s0, 6) AS spend_first FROM ind")
def history_from_wide(spark, sf):
    """The wide adapter: yearly counts as Y columns, yearly spend as a time-varying covariate."""
    p = population(spark, sf).df
    wide = p.select("id", *[F.element_at("h", i + 1).alias(f"Y{y}") for i, y in enumerate(YEARS)], *[F.element_at("spend", i + 1).alias(f"spend_{y}") for i, y in enumerate(YEARS)])
    frame = from_wide(wide, id_col="id")
    return r6(frame.df.select("id", "x", "e", "l", F.element_at("spend", 1).alias("spend_first")))


@query("validate_histories", f"WITH {OPEN} SELECT count(*) AS n, count(*) FILTER (NOT regexp_full_match(ch, '[01]+')) AS malformed, count(DISTINCT length(ch)) AS lengths, CAST(min(length(ch)) AS INT) AS shortest, CAST(max(length(ch)) AS INT) AS longest FROM ind")
def validate_histories(spark, sf):
    return validate.history_report(population(spark, sf).df)


@query("validate_matrix", f"""WITH {OPEN}, a AS (SELECT x, ch, [{', '.join(f'h{i}' for i in range(T))}] AS h FROM ind)
SELECT count(*) AS n, CAST(min(len(h)) AS INT) AS least, CAST(max(len(h)) AS INT) AS most, count(*) FILTER (len(list_filter(h, lambda v: v NOT IN (0, 1))) > 0) AS not_binary,
 CAST(sum(list_sum(h)) AS BIGINT) AS captures, count(*) FILTER (NOT list_contains(h, 1)) AS never FROM a""")
def validate_matrix(spark, sf):
    return validate.matrix_report(population(spark, sf).df)


@query("validate_values", "SELECT count(*) AS n, count(*) FILTER (c_acctbal IS NULL) AS nulls, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal <= 0) AS not_positive, count(*) FILTER (c_acctbal < 0 OR c_acctbal > 1) AS not_probability, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer")
def validate_values(spark, sf):
    return validate.value_report(table(spark, sf, "customer"), "c_acctbal")


@query("sufficient_statistics", f"WITH {OPEN} SELECT CAST(x AS INT) AS x, CAST(e AS INT) AS e, CAST(l AS INT) AS l, segment, count(*) AS n FROM ind GROUP BY x, e, l, segment")
def sufficient_statistics(spark, sf):
    return compressed(population(spark, sf).df, [("segment", F.col("segment"))])


@query("pattern_frequencies", f"WITH {OPEN} SELECT ch, count(*) AS n FROM ind GROUP BY ch")
def pattern_frequencies(spark, sf):
    return population(spark, sf).df.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


_PAIR = " + ".join(f"h{i} * h{i + 1}" for i in range(T - 1))
_FIRST = " + ".join(f"h{i}" for i in range(T - 1))


@query("empirical_rates", f"WITH {OPEN} SELECT count(*) AS n, round(sum(x) / (count(*) * 7.0::DOUBLE), 6) AS detection, round(sum({_PAIR})::DOUBLE / sum({_FIRST}), 6) AS survival, round(greatest(0.01, count(*) FILTER (e >= 1 AND x > 0) / 6.0::DOUBLE / count(*)), 6) AS recruitment FROM ind")
def empirical_rates(spark, sf):
    return r6(empirical(population(spark, sf).df, T))


@query("likelihood_total", f"WITH {OPEN} SELECT round(sum({ll_sql('0.7', '0.8', '0.4')}), 4) AS ll, count(*) AS n FROM ind")
def likelihood_total(spark, sf):
    """Through grouped statistics, against a sum over individuals."""
    g = compressed(population(spark, sf).df)
    return g.agg(F.round(F.sum(F.col("n") * links.log_likelihood(0.7, 0.8, 0.4, T)), 4).alias("ll"), F.sum("n").alias("n"))


@query("likelihood_individual", f"WITH {OPEN} SELECT id, round({ll_sql('0.7', '0.8', '0.4')}, 6) AS ll FROM ind")
def likelihood_individual(spark, sf):
    return population(spark, sf).df.select("id", F.round(links.log_likelihood(0.7, 0.8, 0.4, T), 6).alias("ll"))


_PHI = "(1 / (1 + exp(-(0.5 + 0.3 * (CASE segment WHEN 'BUILDING' THEN 1 ELSE 0 END) - 0.2 * (CASE segment WHEN 'MACHINERY' THEN 1 ELSE 0 END)))))"
_F = "exp(-0.9 + 0.1 * (CASE segment WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END))"


@query("likelihood_covariates", f"WITH {OPEN}, q AS (SELECT *, {_PHI} AS phi, 0.8::DOUBLE AS p, {_F} AS f FROM ind) SELECT segment, round(sum({ll_sql('phi', 'p', 'f')}), 4) AS ll, round(avg(phi + f), 6) AS growth, round(avg(phi / (phi + f)), 6) AS seniority FROM q GROUP BY segment")
def likelihood_covariates(spark, sf):
    """Linear predictors from compiled formulas at given coefficients."""
    frame = population(spark, sf)
    data = describe(frame.df, ("segment",), T)
    cols = design(parse("~segment"), data)
    names = [n for n, _ in cols]
    theta = lambda **k: [k.get(n.replace("(", "").replace(")", "").replace("segment_", ""), 0.0) for n in names]
    df = frame.df.withColumns({
        "phi": links.inv_logit(links.linear(cols, theta(Intercept=0.5, BUILDING=0.3, MACHINERY=-0.2))), "p": F.lit(0.8),
        "f": F.exp(links.linear(cols, theta(Intercept=-0.9, HOUSEHOLD=0.1))),
    })
    return df.groupBy("segment").agg(
        F.round(F.sum(links.log_likelihood("phi", "p", "f", T)), 4).alias("ll"), F.round(F.avg(links.growth("phi", "f")), 6).alias("growth"), F.round(F.avg(links.seniority("phi", "f")), 6).alias("seniority"),
    )


@query("growth_summary", f"WITH {OPEN}, q AS (SELECT {_PHI} + {_F} AS v FROM ind) SELECT round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75 FROM q")
def growth_summary(spark, sf):
    from fieldmark.operators.infer import growth_summary as summary

    phi = links.inv_logit(0.5 + 0.3 * (F.col("segment") == "BUILDING").cast("int") - 0.2 * (F.col("segment") == "MACHINERY").cast("int"))
    f = F.exp(-0.9 + 0.1 * (F.col("segment") == "HOUSEHOLD").cast("int"))
    return r6(summary(population(spark, sf).df, phi + f))


_AGAIN = " + ".join(f"h{i} * h{i + 1}" for i in range(T - 1))
_BEFORE = " + ".join(f"h{i}" for i in range(T - 1))


@query("capture_curve", f"""WITH {OPEN}, r AS (SELECT segment, sum(x) / (count(*) * {T}.0::DOUBLE) AS p, sum({_AGAIN})::DOUBLE / sum({_BEFORE}) AS phi FROM ind GROUP BY segment)
SELECT segment, occasion, round(p * power(phi, occasion), 6) AS p FROM r, (SELECT CAST(unnest(range({T})) AS INT) AS occasion)""")
def capture_curve(spark, sf):
    """How detection of a cohort falls off, from each segment's empirical survival and detection."""
    again, before = runs(T, "h")
    rate = population(spark, sf).df.groupBy("segment").agg(
        (F.sum("x") / (F.count(F.lit(1)) * F.lit(float(T)))).alias("p"), (F.sum(again).cast("double") / F.sum(before)).alias("phi"),
    )
    return r6(rate.select("segment", F.posexplode(links.capture_curve(F.col("phi"), F.col("p"), T)).alias("occasion", "p")))


@query("design_matrix", f"WITH {OPEN}, z AS (SELECT *, (acctbal - avg(acctbal) OVER ()) / stddev_samp(acctbal) OVER () AS zbal FROM ind) SELECT id, round(zbal, 6) AS zbal, round(zbal * zbal, 6) AS zbal2, CAST(segment = 'BUILDING' AS INT) * 1.0::DOUBLE AS building, round(CAST(segment = 'BUILDING' AS INT) * zbal, 6) AS building_zbal, round(exp(zbal), 6) AS exp_zbal, round(power(zbal, 3), 6) AS zbal3, round(ln(x + 1), 6) AS log_x FROM z")
def design_matrix(spark, sf):
    """Dummies, products, polynomials and functions of a standardised covariate."""
    df = prepare.standardised(population(spark, sf).df, ["acctbal"])
    cols = dict(design(parse("~segment*acctbal + I(acctbal^2) + exp(acctbal) + poly(acctbal, 3) + log(x + 1)"), describe(df, ("segment", "acctbal", "x"), T)))
    pick = {"zbal": "acctbal", "zbal2": "I(acctbal^2)", "building": "segment_BUILDING", "building_zbal": "segment_BUILDING:acctbal", "exp_zbal": "exp(acctbal)", "zbal3": "poly(acctbal, 3)3", "log_x": "log(x + 1)"}
    return r6(df.select("id", *[cols[v].alias(k) for k, v in pick.items()]))


_VARY = ", ".join(f"round(coalesce(s{i}, rm, am), 4) AS spend_t{i}" for i in range(T))
_ROWSUM, _ROWN = " + ".join(f"coalesce(s{i}, 0)" for i in range(T)), " + ".join(f"CAST(s{i} IS NOT NULL AS INT)" for i in range(T))


@query("varying_numeric", f"WITH {OPEN}, a AS (SELECT sum({_ROWSUM}) / sum({_ROWN}) AS am FROM ind), q AS (SELECT *, CASE WHEN ({_ROWN}) > 0 THEN ({_ROWSUM}) / ({_ROWN}) END AS rm FROM ind, a) SELECT id, {_VARY} FROM q")
def varying_numeric(spark, sf):
    """A time-varying covariate: gaps filled, then one column an occasion."""
    df = prepare.row_filled(population(spark, sf).df, "spend")
    cols = design(parse("~0 + spend"), describe(df, ("spend",), T))
    return rounded(df.select("id", *[c.alias(n) for n, c in cols]), 4)


@query("varying_levels", f"WITH {OPEN} SELECT id, {', '.join(f'CAST(t{i} = {v} AS INT) * 1.0::DOUBLE AS tier_{v}_t{i}' for i in range(T) for v in (1, 2))} FROM ind")
def varying_levels(spark, sf):
    """A time-varying category in a formula: a column an occasion and level but the first."""
    df = population(spark, sf).df.withColumn("tier", F.col("tier").cast("array<string>"))
    cols = design(parse("~0 + tier"), describe(df, ("tier",), T))
    return df.select("id", *[c.alias(n) for n, c in cols])


@query("formula_functions", f"WITH {OPEN} SELECT id, round(ln(x + 1), 6) AS log_x, round(sqrt(x), 6) AS sqrt_x, round(sin(x), 6) AS sin_x, round(cos(x), 6) AS cos_x, round(tan(x), 6) AS tan_x, round(exp(-x), 6) AS exp_x FROM ind")
def formula_functions(spark, sf):
    df = population(spark, sf).df
    cols = design(parse("~0 + log(x + 1) + sqrt(x) + sin(x) + cos(x) + tan(x) + exp(-x)"), describe(df, ("x",), T))
    return r6(df.select("id", *[c.alias(n) for n, (_, c) in zip(("log_x", "sqrt_x", "sin_x", "cos_x", "tan_x", "exp_x"), cols)]))


_LOGS = "ln(greatest(least({v}, 1 - 1e-6), 1e-6))"


@query("prior_terms", f"""WITH {OPEN}, q AS (SELECT {_PHI} AS phi, {_F} AS f FROM ind), r AS (SELECT *, greatest(least(phi, 1 - 1e-6), 1e-6) AS c, ln(0.05) + 0.75 * 0.75 AS mu FROM q)
SELECT round(sum(1.0 * ln(c) + 2.0 * ln(1 - c)), 4) AS beta, round(sum(-ln(f) - power(ln(f) - mu, 2) / (2 * 0.75 * 0.75) - ln(0.75) - 0.5 * ln(2 * pi())), 4) AS recruitment,
 round(avg(ln(phi + 1e-12) + ln(1 - phi + 1e-12)), 6) AS barrier, round(avg(0.5 * (ln(phi + 1e-12) + ln(1 - phi + 1e-12))), 6) AS jeffreys FROM r""")
def prior_terms(spark, sf):
    """Priors and penalties of the objective at given coefficients."""
    phi, f = _at_coefficients()
    one = population(spark, sf).df.agg(
        F.round(F.sum(links.log_beta_prior(phi, 2.0, 3.0)), 4).alias("beta"), F.round(F.sum(links.log_normal_prior(f)), 4).alias("recruitment"),
        F.round(F.avg(links.barrier(phi)), 6).alias("barrier"), F.round(F.avg(links.barrier(phi, jeffreys=True)), 6).alias("jeffreys"),
    )
    return one


def _at_coefficients():
    phi = links.inv_logit(0.5 + 0.3 * (F.col("segment") == "BUILDING").cast("int") - 0.2 * (F.col("segment") == "MACHINERY").cast("int"))
    return phi, F.exp(-0.9 + 0.1 * (F.col("segment") == "HOUSEHOLD").cast("int"))


@query("penalised_objective", f"""WITH {OPEN}, s AS (SELECT sum({ll_sql('1 / (1 + exp(-0.5))', '1 / (1 + exp(-1.2))', 'exp(-0.9)')}) AS ll FROM ind)
SELECT round(ll, 4) AS ll, round(ll - 0.1 * (0.25 + 1.44 + 0.81), 4) AS l2, round(ll, 4) AS ridge FROM s""")
def penalised_objective(spark, sf):
    """The objective of the optimiser at given coefficients: plain, with an L2 penalty on all, with a ridge that spares intercepts."""
    import numpy as np

    from fieldmark.operators.fit import Penalty, Problem, point, sums

    theta, names = np.array([0.5, 1.2, -0.9]), [("phi", "(Intercept)"), ("p", "(Intercept)"), ("f", "(Intercept)")]

    def run(batches):
        for pdf in batches:
            one = np.ones((len(pdf), 1))
            q = Problem(*(pdf[c].to_numpy(float) for c in ("x", "e", "l", "n")), (one, one, one), T)
            yield pdf.head(1).assign(s=[sums(theta, q).tolist()])[["s"]] if len(pdf) else pdf.assign(s=None)[["s"]]

    part = compressed(population(spark, sf).df).mapInPandas(run, "s array<double>")
    total = np.array(part.agg(*[F.sum(F.col("s")[j]) for j in range(14)]).first(), float)
    value = lambda p: float(point(theta, total, p, p.mask(names)).value)
    return spark.createDataFrame([(round(float(total[0]), 4), round(value(Penalty(ridge=0.1, intercepts=True)), 4), round(value(Penalty(ridge=0.1)), 4))], "ll double, l2 double, ridge double")


_ROW = {
    "phi": "~segment", "p": "~1", "f": "~segment",
    "params": [{"param": k, "idx": i, "estimate": v} for k, own in (("phi", [0.5, 0.3, 0.1, 0.0, -0.2]), ("p", [1.1]), ("f", [-0.9, 0.0, 0.05, 0.1, 0.0])) for i, v in enumerate(own)],
}
_SEGMENT = lambda values: "(CASE segment " + " ".join(f"WHEN '{s}' THEN {v}::DOUBLE" for s, v in values.items()) + " ELSE 0.0::DOUBLE END)"
_PHI2 = f"(1 / (1 + exp(-(0.5 + {_SEGMENT({'BUILDING': 0.3, 'FURNITURE': 0.1, 'MACHINERY': -0.2})}))))"
_F2, _P2 = f"exp(-0.9 + {_SEGMENT({'FURNITURE': 0.05, 'HOUSEHOLD': 0.1})})", "(1 / (1 + exp(-1.1)))"


@query("predicted_rates", f"WITH {OPEN}, q AS (SELECT *, {_PHI2} AS phi, {_P2} AS p, {_F2} AS f FROM ind) SELECT id, round(phi, 6) AS phi, round(p, 6) AS p, round(f, 6) AS f, round(phi + f, 6) AS lambda, round({ll_sql('phi', 'p', 'f')}, 6) AS log_likelihood FROM q")
def predicted_rates(spark, sf):
    """Survival, detection, recruitment and growth of each individual under a fit's coefficients."""
    from fieldmark.operators.fit import predicted

    return r6(predicted(population(spark, sf), _ROW).select("id", "phi", "p", "f", "lambda", "log_likelihood"))


@query("prediction_summary", f"""WITH {OPEN}, q AS (SELECT *, {_PHI2} AS phi, {_P2} AS p, {_F2} AS f FROM ind)
SELECT round(avg(phi), 6) AS phi_mean, round(stddev_pop(phi), 6) AS phi_sd, round(avg(p), 6) AS p_mean, round(stddev_pop(p), 6) AS p_sd, round(avg(f), 6) AS f_mean, round(stddev_pop(f), 6) AS f_sd,
 round(sum({ll_sql('phi', 'p', 'f')}), 4) AS log_likelihood, round(22 - 2 * sum({ll_sql('phi', 'p', 'f')}), 4) AS aic, round(avg(phi + f), 6) AS lambda_mean, round(median(phi + f), 6) AS lambda_median,
 round(min(phi + f), 6) AS lambda_least, round(max(phi + f), 6) AS lambda_most, round(quantile_cont(phi + f, 0.25), 6) AS lambda_q25, round(quantile_cont(phi + f, 0.75), 6) AS lambda_q75 FROM q""")
def prediction_summary(spark, sf):
    from fieldmark.operators.fit import predicted
    from fieldmark.operators.fit import prediction_summary as summary

    one = summary(predicted(population(spark, sf), _ROW), len(_ROW["params"])).drop("lambda_sd")
    return r6(one.withColumns({c: F.round(c, 4) for c in ("log_likelihood", "aic")}))


@query("recodes", """SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 2 THEN 'Female' ELSE 'Male' END AS gender,
 CASE WHEN v IS NULL THEN 'Unknown' WHEN v <= 1 THEN 'Tier_1' WHEN v <= 2 THEN 'Tier_2' WHEN v <= 3 THEN 'Tier_3' ELSE 'Tier_Higher' END AS tier_history,
 CASE WHEN c_nationkey % 3 = 1 THEN 'Tier_1_Permit' WHEN c_nationkey % 3 = 2 THEN 'Tier_2_Permit' ELSE 'No_Permit' END AS tier,
 CASE WHEN c_nationkey % 3 IN (1, 2) THEN 'Yes' ELSE 'No' END AS has_permit,
 CASE WHEN c_nationkey % 3 = 1 THEN 'Tier_1' WHEN c_nationkey % 3 = 2 THEN 'Tier_2' ELSE 'None' END AS choice
FROM (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 2000 END AS v FROM customer)""")
def recodes(spark, sf):
    c = table(spark, sf, "customer").withColumn("v", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 2000)).withColumn("k", F.col("c_nationkey") % 3)
    k = F.col("k")
    return c.select(F.col("c_custkey").alias("id"), prepare.gender_label(k).alias("gender"), prepare.tier_history_label(F.col("v")).alias("tier_history"), prepare.permit_label(k).alias("tier"), prepare.has_permit(k).alias("has_permit"), prepare.permit_choice(k).alias("choice"))


@query("standardise_and_fill", "WITH q AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer), m AS (SELECT id, coalesce(v, avg(v) OVER ()) AS v FROM q) SELECT id, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 6) AS v FROM m")
def standardise_and_fill(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    return r6(prepare.standardised(prepare.mean_filled(q, ["v"]), ["v"]))


@query("level_codes", "SELECT c_custkey AS id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS code FROM customer")
def level_codes(spark, sf):
    return prepare.level_codes(table(spark, sf, "customer"), "c_mktsegment").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment_code").cast("int").alias("code"))


@query("categorical_columns", "SELECT 'c_mktsegment' AS \"column\", count(DISTINCT c_mktsegment) AS \"distinct\", true AS categorical FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey), count(DISTINCT c_nationkey) < 10 FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal), false FROM customer")
def categorical_columns(spark, sf):
    return prepare.looks_categorical(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey", "c_acctbal"])


_TIERS = [f"t{i}" for i in range(T)]


@query("annual_permits", f"WITH {OPEN}, q AS (SELECT id, ch, CASE WHEN nation % 3 = 0 THEN 1 WHEN nation % 3 = 1 THEN 0 END AS gender, acctbal AS age, greatest({', '.join(f'CAST({t} = 2 AS INT)' for t in _TIERS)}) AS tier2_dummy FROM ind), k AS (SELECT * FROM q WHERE gender IS NOT NULL AND age > 0) SELECT id, ch, gender, CAST(tier2_dummy AS INT) AS tier2_dummy, round((age - avg(age) OVER ()) / stddev_samp(age) OVER (), 6) AS age FROM k")
def annual_permits(spark, sf):
    df = population(spark, sf).df.select("id", F.when(F.col("nation") % 3 == 0, "M").when(F.col("nation") % 3 == 1, "F").alias("gender"), F.col("acctbal").alias("age"), *[F.element_at("tier", i + 1).alias(f"tier_{y}") for i, y in enumerate(YEARS)])
    return r6(prepare.annual_permits(df, [f"tier_{y}" for y in YEARS]).select("id", "ch", "gender", "tier2_dummy", "age"))


@query("consecutive_captures", f"WITH {OPEN}, lng AS (SELECT id, unnest([{', '.join(f'{{t: {i}, h: h{i}}}' for i in range(T))}]) AS q FROM ind) SELECT q.t AS occasion, CAST(sum(q.h) AS BIGINT) AS captured, CAST(coalesce(sum(q.h * nxt), 0) AS BIGINT) AS again, CAST(sum(CASE WHEN q.h = 1 AND coalesce(before, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS first FROM (SELECT *, lead(q.h) OVER (PARTITION BY id ORDER BY q.t) AS nxt, max(q.h) OVER (PARTITION BY id ORDER BY q.t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lng) GROUP BY q.t")
def consecutive_captures(spark, sf):
    """Captured, captured again at the next occasion, captured for the first time: within arrays, no shuffle by individual."""
    df = population(spark, sf).df.select("h", "e", F.posexplode("h").alias("occasion", "v"))
    again = F.col("v") * F.get("h", F.col("occasion") + 1)
    return df.groupBy("occasion").agg(F.sum("v").alias("captured"), F.coalesce(F.sum(again), F.lit(0)).alias("again"), F.count_if(F.col("occasion") == F.col("e")).alias("first"))


@query("data_fingerprint", f"""WITH {OPEN}, h AS (SELECT CAST('0x' || substr(md5(id || ':' || ch), 1, 15) AS BIGINT) AS h FROM ind)
SELECT substr(md5(count(*) || '/' || CAST(sum(h) AS VARCHAR) || '/' || bit_xor(h)), 1, 16) AS fingerprint, count(*) AS n FROM h""")
def data_fingerprint(spark, sf):
    """Of all individuals."""
    return validate.fingerprint(population(spark, sf).df)


@query("stratum_flags", f"WITH {OPEN} SELECT greatest({', '.join(_TIERS)}) >= 2 AS ever, count(*) AS n FROM ind GROUP BY 1")
def stratum_flags(spark, sf):
    df = _tiered(spark, sf)
    return df.groupBy(sampling.ever_tier(sampling.tier_columns(df)).alias("ever")).agg(F.count(F.lit(1)).alias("n"))


def _tiered(spark: SparkSession, sf: str) -> DataFrame:
    return population(spark, sf).df.select("id", *[F.element_at("tier", i + 1).alias(f"tier_{i}") for i in range(T)])


_EVER = f"greatest({', '.join(_TIERS)}) >= 2"
_ORDER = "ORDER BY md5('42-' || id), id"


@query("stratified_sample", f"WITH {OPEN}, s AS (SELECT id, {_EVER} AS ever, row_number() OVER (PARTITION BY {_EVER} {_ORDER}) AS r, count(*) FILTER ({_EVER}) OVER () AS a, count(*) FILTER (NOT ({_EVER})) OVER () AS b, count(*) OVER () AS n FROM ind), q AS (SELECT *, least(30, a) AS ka0 FROM s), w AS (SELECT *, least(60 - ka0, b) AS kb FROM q), v AS (SELECT *, least(60 - kb, a) AS ka FROM w) SELECT id, ever FROM v WHERE n <= 60 OR r <= CASE WHEN ever THEN ka ELSE kb END")
def stratified_sample(spark, sf):
    df = _tiered(spark, sf)
    ever = sampling.ever_tier(sampling.tier_columns(df))
    return sampling.stratified(df, 60, ever, 0.5).select("id", ever.alias("ever"))


@query("train_validation_split", f"WITH {OPEN}, s AS (SELECT id, {_EVER} AS ever, row_number() OVER (PARTITION BY {_EVER} {_ORDER}) AS r, count(*) OVER (PARTITION BY {_EVER}) AS n FROM ind) SELECT ever, r <= greatest(1, floor(n * 0.2::DOUBLE)) AS validation, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM s GROUP BY 1, 2")
def train_validation_split(spark, sf):
    df = _tiered(spark, sf)
    ever = sampling.ever_tier(sampling.tier_columns(df))
    out = sampling.train_validation(df, 0.2, ever)
    return out.groupBy(ever.alias("ever"), "validation").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("exact_folds", "WITH s AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY md5('42-' || c_custkey), c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) SELECT id, CAST(least(4, r // (n // 5)) AS INT) AS fold FROM s")
def exact_folds(spark, sf):
    return sampling.exact_folds(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), 5).select("id", "fold")


@query("bootstrap_weights", f"WITH u AS (SELECT c_custkey AS id, (CAST('0x' || substr(md5('7-' || c_custkey), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM customer) SELECT id, CAST({' + '.join(f'CAST(u > {t!r}::DOUBLE AS INT)' for t in sampling.poisson_steps())} AS INT) AS w FROM u")
def bootstrap_weights(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), sampling.poisson_weight(7, "c_custkey").alias("w"))


@query("batches", "SELECT c_custkey AS id, CAST(floor((CAST('0x' || substr(md5('42-' || c_custkey), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE * 4) AS INT) AS batch FROM customer")
def batches(spark, sf):
    return sampling.batches(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), 250, 1000).select("id", "batch")
