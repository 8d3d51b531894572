"""Criteria, comparison tables, averaging, goodness of fit and holdout at given fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions import links
from fieldmark.operators import agree, infer, sampling, select
from fieldmark.operators.fit import fit
from fieldmark.operators.suffstat import compressed
from fieldmark.plans.base import OPEN, T, chi2_sf_sql, ll_sql, population, query
from fieldmark.plans.newton import newton_sql
from fieldmark.sources.histories import rounded

#: Twelve candidate models: id, phi, p, f, parameters counted, whether the growth rate is known.
GRID = [(i, round(0.655 + 0.0008 * ((i * 7) % 12), 4), round(0.78 + 0.001 * (i % 5), 4), round(0.455 + 0.001 * ((i * 5) % 11), 4), 3 + i % 4, i != 7) for i in range(1, 13)]
_TRAIN = "((CAST('0x' || substr(md5('42-' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) < 0.8"
_VALUES = ", ".join(f"({i}, {phi}::DOUBLE, {p}::DOUBLE, {f}::DOUBLE, {k}, {'TRUE' if known else 'FALSE'})" for i, phi, p, f, k, known in GRID)
FITS_SQL = f"""{OPEN}, cand(model_id, phi, p, f, k, known) AS (VALUES {_VALUES}),
each AS (SELECT model_id, phi, p, f, k, known, {_TRAIN} AS train, {ll_sql('phi', 'p', 'f')} AS v FROM ind, cand),
raw AS (SELECT model_id, k, round(sum(v), 4) AS ll, count(*) AS n, CASE WHEN known THEN phi + f END AS lambda_mean, round(-avg(v) FILTER (NOT train), 6) AS loss,
 round(abs(avg(v) FILTER (train) - avg(v) FILTER (NOT train)) / abs(avg(v) FILTER (train)), 6) AS overfitting FROM each GROUP BY model_id, phi, p, f, k, known),
fits AS (SELECT *, 2.0::DOUBLE * k - 2 * ll AS aic, k * ln(n) - 2 * ll AS bic FROM raw)"""
COMPARED = "cmp AS (SELECT *, aic - min(aic) OVER () AS delta, exp(-(aic - (SELECT min(aic) FROM fits)) / 2) / (SELECT sum(exp(-(aic - (SELECT min(aic) FROM fits)) / 2)) FROM fits) AS weight FROM fits)"


def fits(spark, sf):
    """The candidates judged on the population: log-likelihood, loss on held-out individuals, criteria.  Grouped counts meet a row a model."""
    train = sampling.uniform(42, "id") < 0.8
    g = compressed(population(spark, sf).df, [("train", train)])
    grid = spark.createDataFrame(GRID, "model_id int, phi double, p double, f double, n_parameters int, known boolean")
    v = links.log_likelihood("phi", "p", "f", T)
    n = lambda c: F.sum(F.when(c, F.col("n")))
    s = lambda c: F.sum(F.when(c, F.col("n") * F.col("v")))
    one = g.crossJoin(F.broadcast(grid)).withColumn("v", v).groupBy("model_id", "phi", "p", "f", "n_parameters", "known")
    out = one.agg(F.round(F.sum(F.col("n") * F.col("v")), 4).alias("log_likelihood"), F.sum("n").alias("n"), (s(F.col("train")) / n(F.col("train"))).alias("a"), (s(~F.col("train")) / n(~F.col("train"))).alias("b"))
    out = out.select("model_id", "n_parameters", "log_likelihood", "n", F.when(F.col("known"), F.col("phi") + F.col("f")).alias("lambda_mean"), F.round(-F.col("b"), 6).alias("loss"), F.round(F.abs(F.col("a") - F.col("b")) / F.abs("a"), 6).alias("overfitting"))
    return infer.with_criteria(out)


@query("information_criteria", f"WITH {FITS_SQL} SELECT model_id, round(aic, 6) AS aic, round(bic, 6) AS bic, round(aic + 2.0 * k * (k + 1) / (n - k - 1), 6) AS aicc, round(-2 * ll, 6) AS deviance, round(aic / 1.4, 6) AS qaic, round((aic + 2.0 * k * (k + 1) / (n - k - 1)) / 1.4, 6) AS qaicc FROM fits")
def information_criteria(spark, sf):
    df = infer.with_criteria(fits(spark, sf).select("model_id", "log_likelihood", "n_parameters", "n"), c_hat=1.4)
    return rounded(df.select("model_id", "aic", "bic", "aicc", "deviance", "qaic", "qaicc"))


@query("model_comparison", f"WITH {FITS_SQL}, {COMPARED} SELECT model_id, CAST(row_number() OVER (ORDER BY aic, model_id) AS INT) AS rank, round(delta, 6) AS delta, round(weight, 6) AS weight, round(log10((SELECT max(weight) FROM cmp) / weight), 6) AS log10_evidence, round(sum(weight) OVER (ORDER BY aic, model_id), 6) AS cumulative_weight, CASE WHEN delta <= 2 THEN 'substantial' WHEN delta <= 7 THEN 'some' ELSE 'little' END AS support FROM cmp")
def model_comparison(spark, sf):
    c = select.comparison(fits(spark, sf))
    return rounded(c.withColumn("log10_evidence", F.log10("evidence_ratio")).select("model_id", "rank", "delta", "weight", "log10_evidence", "cumulative_weight", "support"))


@query("best_model", f"WITH {FITS_SQL} SELECT model_id, round(aic, 6) AS aic FROM fits ORDER BY aic, model_id LIMIT 1")
def best_model(spark, sf):
    return rounded(select.best(fits(spark, sf)).select("model_id", "aic"))


@query("two_rankings", f"WITH {FITS_SQL} SELECT model_id, CAST(row_number() OVER (ORDER BY aic, model_id) AS INT) AS aic_rank, CAST(row_number() OVER (ORDER BY bic, model_id) AS INT) AS bic_rank, round(aic - min(aic) OVER (), 6) AS aic_delta, round(bic - min(bic) OVER (), 6) AS bic_delta FROM fits")
def two_rankings(spark, sf):
    return rounded(select.two_rankings(fits(spark, sf)).select("model_id", "aic_rank", "bic_rank", "aic_delta", "bic_delta"))


@query("model_average", f"""WITH {FITS_SQL}, f AS (SELECT * FROM fits WHERE lambda_mean IS NOT NULL), m AS (SELECT min(aic) AS lo FROM f), w0 AS (SELECT f.*, exp(-(aic - lo) / 2) AS u FROM f, m), w AS (SELECT *, u / (SELECT sum(u) FROM w0) AS w FROM w0), a AS (SELECT sum(w * lambda_mean) AS avg_l FROM w)
SELECT count(*) AS models, round(any_value(avg_l), 6) AS average, round(sqrt(sum(w * power(lambda_mean - avg_l, 2))), 6) AS between_sd, round(-sum(w * ln(w + 1e-10)), 6) AS entropy, CASE WHEN -sum(w * ln(w + 1e-10)) / ln(count(*)) < 0.3 THEN 'low' WHEN -sum(w * ln(w + 1e-10)) / ln(count(*)) < 0.7 THEN 'moderate' ELSE 'high' END AS uncertainty FROM w, a""")
def model_average(spark, sf):
    return rounded(select.averaged(fits(spark, sf)))


@query("pairwise_models", f"WITH {FITS_SQL} SELECT a.model_id AS a_id, b.model_id AS b_id, round(a.aic - b.aic, 6) AS delta, round(exp(-abs(a.aic - b.aic) / 2), 6) AS relative_likelihood, round(a.bic - b.bic, 6) AS delta_bic FROM fits a JOIN fits b ON a.model_id < b.model_id")
def pairwise_models(spark, sf):
    return rounded(infer.pairwise(fits(spark, sf), also=("bic",)))


@query("loss_ranks", f"WITH {FITS_SQL} SELECT model_id, CAST(row_number() OVER (ORDER BY aic, model_id) AS INT) AS ic_rank, CAST(row_number() OVER (ORDER BY loss, model_id) AS INT) AS loss_rank FROM fits")
def loss_ranks(spark, sf):
    return select.loss_and_ic_ranks(fits(spark, sf), "loss").select("model_id", "ic_rank", "loss_rank")


@query("holdout_summary", f"WITH {FITS_SQL} SELECT k AS n_parameters, round(avg(loss), 6) AS mean_loss, round(stddev_pop(loss), 6) AS sd_loss, round(avg(overfitting), 6) AS mean_overfitting, round(stddev_pop(overfitting), 6) AS sd_overfitting, count(*) AS n FROM fits GROUP BY 1")
def holdout_summary(spark, sf):
    return rounded(select.holdout_summary(fits(spark, sf), "loss", "overfitting", ["n_parameters"]))


@query("triangulation", f"WITH {FITS_SQL}, {COMPARED} SELECT count(*) AS models, round(max(weight), 6) AS best_weight, round(1 - max(weight), 6) AS uncertainty, count(*) FILTER (delta <= 2) AS supported, round(stddev_pop(aic) / avg(aic), 8) AS ic_cv, CASE WHEN count(*) FILTER (delta <= 2) = 1 THEN 'clear preference' WHEN count(*) FILTER (delta <= 2) > 3 THEN 'high uncertainty' ELSE 'moderate uncertainty' END AS assessment FROM cmp")
def triangulation(spark, sf):
    params = fits(spark, sf).select(F.lit("f").alias("param"), F.lit("(Intercept)").alias("term"), F.col("lambda_mean").alias("estimate"))
    models, _ = select.triangulated(fits(spark, sf), params)
    return models.select("models", F.round("best_weight", 6).alias("best_weight"), F.round("uncertainty", 6).alias("uncertainty"), "supported", F.round("ic_cv", 8).alias("ic_cv"), "assessment")


@query("triangulation_parameters", f"WITH {FITS_SQL} SELECT 'f' AS param, '(Intercept)' AS term, round(min(lambda_mean), 6) AS least, round(max(lambda_mean), 6) AS most, round(max(lambda_mean) - min(lambda_mean), 6) AS range, round(stddev_pop(lambda_mean) / abs(avg(lambda_mean)), 6) AS cv FROM fits")
def triangulation_parameters(spark, sf):
    params = fits(spark, sf).select(F.lit("f").alias("param"), F.lit("(Intercept)").alias("term"), F.col("lambda_mean").alias("estimate"))
    return rounded(select.triangulated(fits(spark, sf), params)[1].select("param", "term", "least", "most", "range", "cv"))


_GROUPS = "obs AS (SELECT x, count(*)::DOUBLE AS observed FROM ind GROUP BY x), ex AS (SELECT o.x, observed, power(0.62::DOUBLE, o.x) * power(0.38::DOUBLE, 7 - o.x) * (SELECT sum(observed) FROM obs) * CASE o.x WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 21 WHEN 3 THEN 35 WHEN 4 THEN 35 WHEN 5 THEN 21 WHEN 6 THEN 7 ELSE 1 END AS expected FROM obs o)"


def cells(spark, sf):
    """Captures per individual against a binomial expectation."""
    obs = population(spark, sf).df.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("observed"))
    total = F.broadcast(obs.agg(F.sum("observed").alias("total")))  # one row
    comb = F.element_at(F.array(*[F.lit(v) for v in (1, 7, 21, 35, 35, 21, 7, 1)]), F.col("x") + 1)
    return obs.crossJoin(total).select("x", "observed", (F.power(F.lit(0.62), F.col("x")) * F.power(F.lit(0.38), 7 - F.col("x")) * F.col("total") * comb).alias("expected"))


@query("goodness_of_fit", f"WITH {OPEN}, {_GROUPS}, s AS (SELECT sum(power(observed - expected, 2) / greatest(expected, 1e-10)) AS pearson, sum(CASE WHEN observed > 0 THEN 2 * observed * ln(observed / greatest(expected, 1e-10)) ELSE 0 END) AS deviance, count(*) AS cells FROM ex) SELECT round(pearson, 4) AS pearson, round(deviance, 4) AS deviance, cells, greatest(cells - 2, 1) AS df, round(greatest(pearson / greatest(cells - 2, 1), 1), 4) AS c_hat, pearson / greatest(cells - 2, 1) > 1.5 AS overdispersed FROM s")
def goodness_of_fit(spark, sf):
    return rounded(infer.goodness(cells(spark, sf), parameters=1), 4)


@query("goodness_by_segment", f"""WITH {OPEN}, w AS (SELECT x, count(*)::DOUBLE / (SELECT count(*) FROM ind) AS share FROM ind GROUP BY x),
g AS (SELECT segment, count(*)::DOUBLE AS n FROM ind GROUP BY segment), o AS (SELECT segment, x, count(*)::DOUBLE AS observed FROM ind GROUP BY segment, x),
c AS (SELECT segment, x, coalesce(observed, 0) AS o, n * share AS e FROM g CROSS JOIN w LEFT JOIN o USING (segment, x)),
s AS (SELECT segment, sum((o - e) * (o - e) / e) AS pearson, sum(CASE WHEN o > 0 THEN 2 * o * ln(o / e) ELSE 0 END) AS deviance, count(*) AS cells, greatest(count(*) - 1, 1) AS df FROM c GROUP BY segment)
SELECT segment, round(pearson, 4) AS pearson, round(deviance, 4) AS deviance, cells, df, round({chi2_sf_sql('pearson', 'df')}, 6) AS pearson_p, round({chi2_sf_sql('deviance', 'df')}, 6) AS deviance_p FROM s""")
def goodness_by_segment(spark, sf):
    """Whether each segment's captures are spread as the population's are, with p values."""
    ind = population(spark, sf).df.select("segment", "x")
    counts = ind.groupBy("segment", "x").agg(F.count(F.lit(1)).alias("observed"))  # a row a segment and number of captures
    every = counts.agg(F.sum("observed").cast("double").alias("total"))
    share = counts.groupBy("x").agg(F.sum("observed").alias("m")).crossJoin(F.broadcast(every)).select("x", (F.col("m") / F.col("total")).alias("share"))
    size = counts.groupBy("segment").agg(F.sum("observed").alias("size"))
    cells = size.crossJoin(F.broadcast(share)).join(counts, ["segment", "x"], "left")  # shares: a row a number of captures
    cells = cells.select("segment", F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("size") * F.col("share")).alias("expected"))
    out = infer.goodness(cells, by=("segment",), with_p=True)
    rounds = {"pearson": 4, "deviance": 4, "pearson_p": 6, "deviance_p": 6}
    return out.select("segment", "cells", "df", *[F.round(c, k).alias(c) for c, k in rounds.items()])


@query("residuals", f"WITH {OPEN}, {_GROUPS} SELECT CAST(x AS INT) AS x, round((observed - expected) / sqrt(greatest(expected, 1e-10)), 5) AS pearson, round(sign(observed - expected) * sqrt(greatest(2 * (observed * ln(observed / expected) - (observed - expected)), 0)), 5) AS deviance, round((observed - expected) / sqrt(expected) / sqrt(greatest(1 - expected / sum(expected) OVER (), 1e-10)), 5) AS standardised FROM ex")
def residuals(spark, sf):
    return rounded(infer.residuals(cells(spark, sf)).select("x", "pearson", "deviance", "standardised"), 5)


@query("holdout_metrics", f"WITH {OPEN}, q AS (SELECT {ll_sql('0.66', '0.78', '0.46')} AS ll, {_TRAIN} AS train FROM ind), s AS (SELECT sum(ll) FILTER (train) AS a, count(*) FILTER (train) AS n, sum(ll) FILTER (NOT train) AS b, count(*) FILTER (NOT train) AS m FROM q) SELECT round(a, 4) AS train_ll, n AS train_n, round(b, 4) AS val_ll, m AS val_n, round(6 - 2 * a, 4) AS train_aic, round(6 - 2 * b, 4) AS val_aic, round(a / n - b / m, 6) AS difference, round(abs(a / n - b / m) / abs(a / n), 6) AS overfitting, CASE WHEN abs(a / n - b / m) / abs(a / n) < 0.05 THEN 'good' WHEN abs(a / n - b / m) / abs(a / n) < 0.15 THEN 'moderate' ELSE 'poor' END AS label FROM s")
def holdout_metrics(spark, sf):
    one = select.holdout(population(spark, sf).df, links.log_likelihood(0.66, 0.78, 0.46, T), sampling.uniform(42, "id") < 0.8, 3)
    return one.select(*[F.round(c, 4).alias(c) if c.endswith(("_ll", "_aic")) else F.round(c, 6).alias(c) if c in ("difference", "overfitting") else F.col(c) for c in ("train_ll", "train_n", "val_ll", "val_n", "train_aic", "val_aic", "difference", "overfitting", "label")])


@query("fold_likelihood", f"WITH {OPEN}, s AS (SELECT *, CAST(least(4, floor((CAST('0x' || substr(md5('42-' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE * 5)) AS INT) AS fold FROM ind) SELECT fold, count(*) AS n, round(avg({ll_sql('0.66', '0.78', '0.46')}), 6) AS mean_ll FROM s GROUP BY fold")
def fold_likelihood(spark, sf):
    df = sampling.folds(population(spark, sf).df, 5)
    return rounded(df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(links.log_likelihood(0.66, 0.78, 0.46, T)).alias("mean_ll")))


@query("fold_summary", f"""WITH {OPEN}, s AS (SELECT *, CAST(least(4, floor((CAST('0x' || substr(md5('42-' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE * 5)) AS INT) AS fold, {ll_sql('0.66', '0.78', '0.46')} AS v FROM ind),
f AS (SELECT fold, avg(v) AS m, ((SELECT sum(v) FROM s) - sum(v)) / ((SELECT count(*) FROM s) - count(*)) AS t FROM s GROUP BY fold)
SELECT count(*) AS folds, round(avg(m), 6) AS mean_ll, round(stddev_pop(m), 6) AS sd_ll, round(avg(t), 6) AS train_mean_ll, round(stddev_pop(m) / abs(avg(m)), 6) AS consistency,
 CASE WHEN stddev_pop(m) / abs(avg(m)) < 0.05 THEN 'consistent' WHEN stddev_pop(m) / abs(avg(m)) < 0.15 THEN 'moderate' ELSE 'inconsistent' END AS label FROM f""")
def fold_summary(spark, sf):
    """Folds of the population judged at given coefficients, and how consistent they are."""
    df = sampling.folds(population(spark, sf).df, 5).groupBy("fold").agg(F.sum(links.log_likelihood(0.66, 0.78, 0.46, T)).alias("val_ll"), F.count(F.lit(1)).alias("val_n"))
    whole = F.broadcast(df.agg(F.sum("val_ll").alias("ll"), F.sum("val_n").alias("m")))  # one row
    rows = df.crossJoin(whole).withColumns({"train_ll": F.col("ll") - F.col("val_ll"), "train_n": F.col("m") - F.col("val_n")})
    return rounded(agree.fold_likelihoods(rows))


@query("quick_fit_test", f"WITH {FITS_SQL} SELECT model_id, round(-2 * ll, 4) AS deviance, n - k AS df, round(-2 * ll / (n - k), 6) AS c_hat FROM fits")
def quick_fit_test(spark, sf):
    out = infer.quick_fit_test(fits(spark, sf).drop("deviance"), with_p=False)
    return out.select("model_id", F.round("deviance", 4).alias("deviance"), "df", F.round("c_hat", 6).alias("c_hat"))


@query("converged_only", f"WITH {FITS_SQL} SELECT model_id, CAST(row_number() OVER (ORDER BY aic, model_id) AS INT) AS rank, round(aic - min(aic) OVER (), 6) AS delta FROM fits WHERE lambda_mean IS NOT NULL")
def converged_only(spark, sf):
    """Only fits that converged are ranked; here those with a growth rate count as such."""
    return rounded(select.comparison(fits(spark, sf).withColumn("converged", F.col("lambda_mean").isNotNull())).select("model_id", "rank", "delta"))


@query("diagnostics", f"""WITH RECURSIVE {OPEN}, {newton_sql()}, {_GROUPS}, s AS (SELECT sum(power(observed - expected, 2) / greatest(expected, 1e-10)) AS pearson, sum(CASE WHEN observed > 0 THEN 2 * observed * ln(observed / greatest(expected, 1e-10)) ELSE 0 END) AS g2, count(*) AS cells FROM ex),
c AS (SELECT *, greatest(cells - 4, 1) AS df, greatest(pearson / greatest(cells - 4, 1), 1) AS c_hat, pearson / greatest(cells - 4, 1) > 1.5 AS over, (SELECT count(*) FROM ind) AS n FROM s, (SELECT ll FROM opt))
SELECT round(pearson, 4) AS pearson, round(g2, 4) AS g2, cells, df, round(c_hat, 4) AS c_hat, over AS overdispersed, round({chi2_sf_sql('pearson', 'df')}, 6) AS pearson_p, round(6 - 2 * ll, 4) AS aic, round((6 - 2 * ll) / CASE WHEN over THEN c_hat ELSE 1 END, 4) AS qaic, round(3 * ln(n) - 2 * ll, 4) AS bic FROM c""")
def diagnostics(spark, sf):
    """Goodness of fit over capture counts, and the fitted constant model's criteria with allowance for overdispersion."""
    row = fit(population(spark, sf))
    out = infer.diagnostics(cells(spark, sf), row["log_likelihood"], row["n_parameters"], row["n"])
    return rounded(out.select("pearson", "g2", "cells", "df", "c_hat", "overdispersed", "pearson_p", "aic", "qaic", "bic"), 4)


@query("reference_growth", f"WITH {OPEN}, e AS (SELECT segment, avg(x) / 10.0 AS phi, -avg(x) / 5.0 AS f FROM ind GROUP BY segment) SELECT segment, round(phi, 6) AS phi, round(f, 6) AS f, round(1 / (1 + exp(-phi)) + exp(f), 6) AS lambda FROM e")
def reference_growth(spark, sf):
    """Growth of the reference individual by data set, from intercepts in long form."""
    e = population(spark, sf).df.groupBy("segment").agg(F.avg("x").alias("m"))
    long = e.select("segment", F.explode(F.array(F.struct(F.lit("phi").alias("param"), (F.col("m") / 10.0).alias("estimate")), F.struct(F.lit("f").alias("param"), (-F.col("m") / 5.0).alias("estimate")))).alias("q"))
    out = infer.reference_growth(long.select("segment", "q.param", "q.estimate", F.lit("(Intercept)").alias("term")), "segment")
    return rounded(out.select("segment", "phi", "f", "lambda"))
