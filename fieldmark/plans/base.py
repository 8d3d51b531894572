"""The population that the queries share: customers, captured in a year when they ordered in it.

*closed* counts every order; *open* keeps years inside a window that follows from an md5 hash of the
customer, so the population has entries and exits.  ``CLOSED`` and ``OPEN`` are the same as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.sources.histories import CaptureFrame, from_events, windowed

YEARS = list(range(1995, 2002))
T = len(YEARS)
#: Yearly maximal order price from which a customer counts as tier 2.
TIER2 = 336148.80

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ordered(spark: SparkSession, sf: str, first: int, last: int) -> DataFrame:
    """Orders of some years, by bounds in the column's own type, which reach the scan (a function of the date doesn't)."""
    o = table(spark, sf, "orders")
    bound = lambda year: F.lit(f"{year}-01-01").cast(o.schema["o_orderdate"].dataType)
    return o.where((F.col("o_orderdate") >= bound(first)) & (F.col("o_orderdate") < bound(last + 1)))


def population(spark: SparkSession, sf: str, kind: str = "open") -> CaptureFrame:
    """id, segment, nation, acctbal, h, ch, x, e, l, and arrays by year: spend, tier."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("acctbal"))
    o = ordered(spark, sf, YEARS[0], YEARS[-1]).select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    price = F.col("o_totalprice")
    frame = from_events(c, o, "id", F.col("y"), YEARS, "o_custkey", {"spend": (F.sum, price), "top": (F.max, price)})
    if kind == "open":  # the window follows from the customer, so orders needn't be hashed
        bits = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(s), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
        ent = bits("e-") % 7
        out = ent + F.floor(F.ln((bits("s-") + 0.5) / F.lit(4294967296.0)) / F.ln(F.lit(0.7)))
        frame = CaptureFrame(frame.df.withColumns({"_ent": ent, "_out": out}), T, frame.names, frame.covariates)
        frame = windowed(frame, F.col("_ent"), F.col("_out"), ("spend", "top"))
        frame = CaptureFrame(frame.df.drop("_ent", "_out"), T, frame.names, frame.covariates)
    df = frame.df.withColumn("tier", F.transform("top", lambda v: F.when(v.isNull(), 0).when(v >= TIER2, 2).otherwise(1))).drop("top")
    return CaptureFrame(df, T, frame.names, ("segment", "nation", "acctbal", "spend", "tier"))


def _sql(kind: str) -> str:
    window = "" if kind == "closed" else "AND year(o_orderdate) - 1995 BETWEEN ent AND ext"
    cells = ",\n ".join(f"coalesce(max(CASE WHEN y = {y} THEN 1 END), 0) AS h{i}, sum(CASE WHEN y = {y} THEN o_totalprice END) AS s{i}, max(CASE WHEN y = {y} THEN o_totalprice END) AS m{i}" for i, y in enumerate(YEARS))
    h = [f"h{i}" for i in range(T)]
    first = "CASE " + " ".join(f"WHEN {c} = 1 THEN {i}" for i, c in enumerate(h)) + f" ELSE {T} END"
    last = "CASE " + " ".join(f"WHEN {c} = 1 THEN {i}" for i, c in reversed(list(enumerate(h)))) + " ELSE -1 END"
    tiers = ", ".join(f"CASE WHEN m{i} IS NULL THEN 0 WHEN m{i} >= {TIER2} THEN 2 ELSE 1 END AS t{i}" for i in range(T))
    return f"""
win AS (SELECT c_custkey AS k, CAST('0x' || substr(md5('e-' || c_custkey), 1, 8) AS BIGINT) % 7 AS ent,
  CAST('0x' || substr(md5('e-' || c_custkey), 1, 8) AS BIGINT) % 7
  + floor(ln((CAST('0x' || substr(md5('s-' || c_custkey), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / ln(0.7::DOUBLE)) AS ext FROM customer),
ord AS (SELECT o_custkey, o_totalprice, year(o_orderdate) AS y FROM orders JOIN win ON o_custkey = k
  WHERE year(o_orderdate) BETWEEN 1995 AND 2001 {window}),
wide AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS acctbal,
 {cells}
 FROM customer LEFT JOIN ord ON o_custkey = c_custkey GROUP BY ALL),
ind AS (SELECT *, {' || '.join(f'CAST({c} AS VARCHAR)' for c in h)} AS ch, {' + '.join(h)} AS x, {first} AS e, {last} AS l, {tiers} FROM wide)"""


CLOSED, OPEN = _sql("closed"), _sql("open")


def tail_sql(rate: str, p: str, n: str) -> str:
    b, s = f"(({rate}) * (1 - ({p})))", f"((1 - ({rate})) / greatest(1 - ({rate}) * (1 - ({p})), 1e-12))"
    return f"({s} + power({b}, {n}) * (1 - {s}))"


def ll_sql(phi: str, p: str, f: str, occasions: int = T) -> str:
    """The log-likelihood of a row with x, e, l."""
    ln = lambda v: f"ln(greatest({v}, 1e-12))"
    gamma = f"(({phi}) / (({phi}) + ({f})))"
    return (
        f"CASE WHEN x > 0 THEN (l - e) * ({ln(phi)} + {ln(gamma)}) + 2 * ((x - 1) * {ln(p)} + ((l - e) - (x - 1)) * {ln(f'1 - ({p})')})"
        f" + {ln(tail_sql(gamma, p, 'e'))} + {ln(tail_sql(phi, p, f'{occasions - 1} - l'))} ELSE 0 END"
    )


def t_sf_sql(t: str, df: str) -> str:
    """Upper tail of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    f = f"power(cos(atan(abs({t}) / sqrt({df})) * k / 400.0::DOUBLE), {df} - 1)"
    area = f"atan(abs({t}) / sqrt({df})) / 1200.0::DOUBLE * list_sum([{f} * CASE WHEN k = 0 OR k = 400 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END FOR k IN range(401)])"
    return f"(0.5::DOUBLE - sign({t}) * exp(lgamma(({df} + 1) / 2.0::DOUBLE) - lgamma({df} / 2.0::DOUBLE)) / sqrt(pi()) * {area})"


def chi2_sf_sql(x: str, df: str) -> str:
    """Upper tail of chi-square by Simpson's rule over the square root (few degrees of freedom, so nothing is left beyond 1600)."""
    x = f"least({x}, 1600)"
    f = f"power(sqrt({x}) * k / 2000.0::DOUBLE, {df} - 1) * exp(-({x}) * k * k / 8000000.0::DOUBLE)"
    area = f"sqrt({x}) / 6000.0::DOUBLE * list_sum([{f} * CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END FOR k IN range(2001)])"
    return f"(1 - {area} / exp(({df} / 2.0::DOUBLE - 1) * ln(2.0::DOUBLE) + lgamma({df} / 2.0::DOUBLE)))"
