"""The thin queries over the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, mixing, pii, quality, url_filter, vector_codes
from .ann import nearest
from .bpe import encode_decode
from .common import stored
from .html_extract import extract
from .language_id import identified
from .lm_score import score
from .minhash import near_duplicates
from .substring_dedup import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitised(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    place = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"], s["to"])), ",")
    of = lambda kind: F.filter("_spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(place(F.filter("_spans", lambda s: s["kind"] != "term")), 256)
    return out.select("doc_id", *counts, base.alias("base_sha256"), place(F.col("_spans")).alias("spans"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold neither fetch dates nor a list, so both follow from ids and hosts by rule.

    Pages are fetched on day ``page_id % 366`` of 2024.  Of the hosts and their parent domains, those
    with an md5 prefix divisible by 3 are blocked from some day, and half of these later allowed again.
    """
    start = F.to_date(F.lit("2024-01-01"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(start, F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_at"))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    both = hosts.unionByName(hosts.where(F.col("host").like("%.%.%") & ~F.col("host").rlike(url_filter.ADDRESS)).select(F.regexp_replace("host", r"^[^.]*\.", "").alias("host"))).distinct()
    both = both.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 8), 16, 10).cast("long")).where("h % 3 = 0")
    entry = lambda action, day: F.struct(F.lit(action).alias("action"), F.date_add(start, day.cast("int")).alias("listed_at"))
    day = F.col("h") % 200
    dated = F.array(entry("block", day), entry("allow", day + 60 + F.col("h") % 50))
    entries = both.select(F.col("host").alias("domain"), F.explode(F.slice(dated, F.lit(1), F.when(F.col("h") % 2 == 0, 2).otherwise(1))).alias("e")).select("domain", "e.*")
    out = url_filter.judged(pages, entries)
    return out.select("page_id", "url", "fetched_at", *[F.col(f"_verdict.{c}").alias(c) for c in ("host", "matched", "action", "since", "kept")])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    out = quality.judged(stored(quality.measured(docs).drop("text"), "measures"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in names], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"], weights=(5, 2, 1), cap=3)
    return out.select("doc_id", *[F.col(f"_mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = filter_audit.text_filters()
    counts = filter_audit.masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), filters=filters)
    return filter_audit.audited(counts, [*filters, "E"])


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.compressed(_table(spark, sf_dir, "embeddings"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select(F.col("id").alias("vec_id"), hexed.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann, op2_html_extract, op3_bpe_encode_decode, op4_lm_score, op5_pii, op6_url_filter, op7_quality_rules,
        op8_mixing, op9_substring_dedup, op10_minhash, op11_language_id, op12_filter_audit, op13_vector_codes,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op6_url_filter"] = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS DATE) AS fetched_at,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)', 1)), '\.+$', ''), '') AS host
  FROM pages),
d AS (
  SELECT host FROM p WHERE host IS NOT NULL
  UNION SELECT regexp_replace(host, '^[^.]*\.', '') FROM p WHERE host LIKE '%.%.%' AND NOT regexp_matches(host, '^(\[.*|[0-9.]+)$')),
h AS (SELECT host AS domain, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS h FROM d),
e AS (
  SELECT domain, 'block' AS action, CAST(DATE '2024-01-01' + CAST(h % 200 AS INTEGER) AS DATE) AS since FROM h WHERE h % 3 = 0
  UNION ALL
  SELECT domain, 'allow', CAST(DATE '2024-01-01' + CAST(h % 200 + 60 + h % 50 AS INTEGER) AS DATE) FROM h WHERE h % 6 = 0),
i AS (SELECT *, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM e),
m AS (
  SELECT p.page_id, i.domain, i.action, i.since,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.domain) DESC) AS k
  FROM p JOIN i ON (p.host = i.domain OR (p.host LIKE '%.' || i.domain AND NOT regexp_matches(p.host, '^(\[.*|[0-9.]+)$')))
   AND contains(i.domain, '.') AND i.since <= p.fetched_at AND (i.until IS NULL OR p.fetched_at < i.until))
SELECT p.page_id, p.url, p.fetched_at, p.host, m.domain AS matched, m.action, m.since, coalesce(m.action <> 'block', true) AS kept
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""

ORACLES["op9_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
k AS (SELECT *, CASE WHEN i + 34 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS k FROM w),
c AS (SELECT k FROM k WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
g AS (SELECT r, i, word, max(CAST(c.k IS NOT NULL AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM k LEFT JOIN c USING (k)),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""

ORACLES["op7_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (SELECT r, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
k AS (SELECT r, i, CASE WHEN i + 7 <= n THEN array_to_string(ws[i:i + 7], ' ') END AS k FROM w),
c AS (SELECT r, k FROM k WHERE k IS NOT NULL GROUP BY r, k HAVING count(*) > 1),
g AS (
  SELECT r, max(CAST(c.k IS NOT NULL AS INT)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS again
  FROM k LEFT JOIN c USING (r, k)),
s AS (SELECT r, sum(again) AS n_repeat_words FROM g GROUP BY r),
m AS (
  SELECT r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN s USING (r)),
x AS (
  SELECT r, lang, source, unnest([
           {'rate': 'symbols', 'x': CAST(n_symbols AS DOUBLE) / greatest(n_words, 1), 'slack': 0.1},
           {'rate': 'word_length', 'x': CAST(word_chars AS DOUBLE) / greatest(n_words, 1), 'slack': 2.0},
           {'rate': 'dup_lines', 'x': CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1), 'slack': 0.2},
           {'rate': 'repeats', 'x': CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1), 'slack': 0.1}], recursive := true)
  FROM m WHERE n_words > 0),
v AS (SELECT *, CASE WHEN x > 0 THEN exp(ceil(ln(x) / ln(1.01 / 0.99)) * ln(1.01 / 0.99)) * 0.99 ELSE 0.0 END AS v FROM x),
q AS (
  SELECT CASE WHEN grouping(source) = 0 THEN 2 WHEN grouping(lang) = 0 THEN 1 ELSE 0 END AS level, lang, source, rate, any_value(slack) AS slack, count(*) AS n,
         quantile_disc(v, 0.1) AS lo, quantile_disc(v, 0.5) AS mid, quantile_disc(v, 0.9) AS hi
  FROM v GROUP BY GROUPING SETS ((lang, source, rate), (lang, rate), (rate))),
f AS (
  SELECT a.lang, a.source, a.rate, a.slack,
         (a.n * a.lo + 50 * (b.n * b.lo + 50 * c.lo) / (b.n + 50)) / (a.n + 50) AS lo,
         (a.n * a.mid + 50 * (b.n * b.mid + 50 * c.mid) / (b.n + 50)) / (a.n + 50) AS mid,
         (a.n * a.hi + 50 * (b.n * b.hi + 50 * c.hi) / (b.n + 50)) / (a.n + 50) AS hi
  FROM q a JOIN q b ON a.rate = b.rate AND a.lang IS NOT DISTINCT FROM b.lang AND b.level = 1 JOIN q c ON a.rate = c.rate AND c.level = 0
  WHERE a.level = 2),
o AS (
  SELECT r FROM x JOIN f ON x.rate = f.rate AND x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source
  WHERE x.x > hi + 3 * (hi - mid) + f.slack OR (x.rate = 'word_length' AND x.x < lo - 3 * (mid - lo) - f.slack) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND o.r IS NULL AS kept
FROM m LEFT JOIN o USING (r)
"""

ORACLES["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS top,
         CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, row_number() OVER (ORDER BY top / w, source NULLS LAST) AS k,
         (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s),
t AS (SELECT source, source_size, least(top, w * (SELECT arg_min(level, k) FROM l WHERE top / w >= level)) AS target FROM l),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS fits FROM t),
r AS (SELECT *, CASE WHEN fits < 3 THEN target - fits * source_size ELSE 0.0 END AS rest FROM u),
h AS (
  SELECT d.source, hash, rest, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY hash) AS up, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY hash) - sum(size) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WHERE rest > 0 GROUP BY d.source, hash, rest),
e AS (SELECT source, max(hash) AS last FROM h WHERE before < rest AND (up <= rest OR up - rest <= rest - before) GROUP BY source)
SELECT d.doc_id, d.size, r.source_size, r.target, CAST(d.size * (fits + CASE WHEN d.hash <= e.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""

ORACLES["op10_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS i FROM d)),
n AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS c FROM s GROUP BY r),
c AS (SELECT c, min(r) AS r, any_value(n) AS n FROM n GROUP BY c),
i AS (SELECT x.r AS a, y.r AS b, count(*) AS met FROM s x JOIN s y ON x.s = y.s AND x.r < y.r WHERE x.r IN (SELECT r FROM c) AND y.r IN (SELECT r FROM c) GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN c p ON p.r = a JOIN c q ON q.r = b WHERE 100 * met >= 85 * (p.n + q.n - met)),
t AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT r, r FROM c),
g(a, b) AS (SELECT a, b FROM t UNION SELECT g.a, t.b FROM g JOIN t ON g.b = t.a),
k AS (SELECT a, min(b) AS k FROM g GROUP BY a),
m AS (SELECT n.r, n.n, k.k FROM n JOIN c USING (c) JOIN k ON k.a = c.r),
f AS (SELECT k, min(doc_id) AS first FROM m JOIN d USING (r) GROUP BY k)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(first, doc_id) AS component_id, doc_id = coalesce(first, doc_id) AS kept
FROM d LEFT JOIN m USING (r) LEFT JOIN f USING (k)
"""

ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM d JOIN f USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
         list_sum([1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step + 1)])::INTEGER AS upto
  FROM o, range(1, 6) r(step))
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (mask & upto = 0), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (mask & upto = own), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & (upto - own) <> 0), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (mask & upto = own), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (mask & upto = own), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * (120 // greatest(bit_count(mask)::BIGINT, 1))) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
FROM s, c GROUP BY part, filter_order, step
"""


def _lloyd_sql() -> str:
    """Four rounds and a last assignment, written out."""
    steps = []
    for k in range(5):
        steps.append(f"""a{k} AS (
  SELECT x.pos, x.part, x.n, min_by(b.entry, (list_dot_product(b.part::DOUBLE[], b.part::DOUBLE[]) - 2 * list_dot_product(x.part::DOUBLE[], b.part::DOUBLE[])) * 256 + b.entry) AS entry
  FROM x JOIN b{k} b ON x.pos = b.pos GROUP BY x.pos, x.part, x.n)""")
        if k < 4:
            steps.append(f"""m{k} AS (
  SELECT pos, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS part
  FROM (SELECT pos, entry, j, sum(n * part[j])::DOUBLE AS s, sum(n)::DOUBLE AS n FROM (SELECT *, unnest(range(1, len(part) + 1)) AS j FROM a{k}) GROUP BY pos, entry, j)
  GROUP BY pos, entry),
b{k + 1} AS (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM b{k} b LEFT JOIN m{k} m USING (pos, entry))""")
    return ",\n".join(steps)


ORACLES["op13_vector_codes"] = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [CAST(floor(1024 * y::DOUBLE) AS BIGINT) FOR y IN embedding] AS q
  FROM embeddings WHERE len(embedding) > 0 AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
p AS (SELECT r, vec_id, label, pos, q[pos * (len(q) // 4) + 1:(pos + 1) * (len(q) // 4)] AS part FROM v, range(4) t(pos)),
x AS (SELECT pos, part, count(*) AS n FROM p GROUP BY pos, part),
b0 AS (SELECT pos, r - 1 AS entry, part FROM p WHERE r <= 256),
{_lloyd_sql()},
g AS (SELECT a.pos, a.part, a.entry, CAST(list_sum([(a.part[j] - b.part[j]) * (a.part[j] - b.part[j]) FOR j IN range(1, len(a.part) + 1)]) AS BIGINT) AS error FROM a4 a JOIN b4 b USING (pos, entry)),
c AS (SELECT r, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(error) AS BIGINT) AS error FROM p JOIN g USING (pos, part) GROUP BY r, vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""
