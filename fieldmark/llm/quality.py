"""Quality rules with adaptive thresholds (DataFrame functions only).

Measures of each text: words, characters in words, symbols, repeated lines, words in repeated
windows.  Their rates go into quantile sketches per language and source: counts in cells whose
bounds grow by a fixed factor, so a quantile is within ``ERROR`` of the true one in proportion, sketches merge
by adding counts, and the result doesn't depend on how rows are dealt out.  A group's quantiles are drawn
towards its language's, and those towards the corpus', as by ``PRIOR`` further documents, so small groups have thresholds of
their own without resting on a few documents.
Outer fences (the ``TAIL`` quantiles plus ``REACH`` times their distance from the median, and a least spread) are
joined back and decide, beside a base rule.  Where a tail quantile is 0, the least spread decides; at ``TAIL``,
junk of up to a tenth of a group doesn't move its own fence.

Edge cases: null texts count as empty (0 words, base_failed); null languages and sources are
groups of their own; repeated rows each count; other columns pass through whatever their names, but for
those that are returned: ``_q``, ``_base_failed``, ``_kept``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, small, stored

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ERROR, PRIOR = 0.01, 50
STEP = math.log((1 + ERROR) / (1 - ERROR))
#: The cell of 0.
NOTHING = -1_000_000
REACH = 3.0
TAIL = 0.9
#: rate -> (expression over the measures ``_q``, least spread added to the fence, has a lower fence)
RATES = {
    "symbols": ("n_symbols / n_words", 0.1, False),
    "word_length": ("word_chars / n_words", 2.0, True),
    "dup_lines": ("n_dup_lines / n_lines", 0.2, False),
    "repeats": ("n_repeat_words / n_words", 0.1, False),
}


def _windows(df: DataFrame, hashes: str, size: int, out: str) -> DataFrame:
    """Column ``out``: hashes of all windows of ``size`` words, by doubling; ``hashes`` is dropped."""
    width, col = 1, hashes
    while width < size:
        step = min(width, size - width)
        n = F.greatest(F.size(col) - step, F.lit(0))
        df = df.withColumn(f"{out}{width}", F.zip_with(F.slice(col, F.lit(1), n), F.slice(col, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))).drop(col)
        width, col = width + step, f"{out}{width}"
    return df.withColumnRenamed(col, out)


def measured(df: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``df`` with a struct ``_q`` (in place of a column of that name): n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    dense = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    hashes = F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))
    df = carried(df, hashes.alias("_h"), lines.alias("_lines"), dense.alias("_dense"), symbols.alias("_symbols"), without=("_q",))
    df = df.withColumns({"_n": F.size("_h").cast("long")})
    df = _windows(df, "_h", window, "_w")
    # positions of windows met twice or more: sorted with their places, equal to a neighbour
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_s", F.when(again, F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: F.get(F.col("_s"), k)["h"].eqNullSafe(x["h"])
    flagged = F.transform("_s", lambda x, k: F.when(twin(x, k - 1) | twin(x, k + 1), x["i"]))
    df = df.withColumn("_p", F.array_sort(F.array_compact(flagged)))
    gaps = F.zip_with(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window)))
    covered = F.coalesce(F.aggregate(gaps, F.lit(window), lambda a, x: a + x), F.lit(0)).cast("long")
    q = F.struct(
        F.col("_n").alias("n_words"),
        F.col("_dense").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    return df.select("row.*", q.alias("_q"))


def _rate(name: str) -> Column:
    top, bottom = RATES[name][0].split(" / ")
    return F.col(f"_q.{top}") / F.greatest(F.col(f"_q.{bottom}"), F.lit(1)).cast("double")


def _cell(x: Column) -> Column:
    """Cell of a rate: 0 has one of its own, the others end at powers of ``(1 + ERROR) / (1 - ERROR)``."""
    return F.when(x > 0, F.ceil(F.ln(x) / F.lit(STEP)).cast("int")).otherwise(F.lit(NOTHING))


def _quantiles(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, n, lo, mid, hi) of each group's sketch, rows (keys, rate, cell, n)."""
    up = Window.partitionBy(*keys, "rate").orderBy("cell")  # a group has some hundred cells
    whole = cells.withColumns({"up": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy(*keys, "rate"))})
    value = F.when(F.col("cell") == NOTHING, F.lit(0.0)).otherwise(F.exp(F.col("cell") * F.lit(STEP)) * (1 - ERROR))
    at = lambda q: F.min(F.when(F.col("up") * 100 >= F.col("all") * round(100 * q), value))
    return whole.groupBy(*keys, "rate").agg(F.sum("n").alias("n"), at(1 - TAIL).alias("lo"), at(0.5).alias("mid"), at(TAIL).alias("hi"))


def fences(df: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, lo_*, hi_*): fences of each language and source."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _cell(_rate(r)).alias("cell")) for r in RATES])).alias("x")
    base = df.where("_q.n_words > 0").select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), each).select("lang", "source", "x.*")
    leaf = stored(base.groupBy("lang", "source", "rate", "cell").agg(F.count(F.lit(1)).alias("n")), "sketches")
    merged = lambda *keys: _quantiles(leaf.groupBy(*keys, "rate", "cell").agg(F.sum("n").alias("n")), list(keys))
    named = lambda df, k: df.select(*[F.col(c).alias(f"{c}{k}") for c in df.columns])
    one, two = named(merged("lang"), 1), named(merged(), 2)  # two has a row a rate
    out = _quantiles(leaf, ["lang", "source"]).join(one, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("rate") == F.col("rate1"))).join(F.broadcast(two), F.col("rate") == F.col("rate2"))
    for q in ("lo", "mid", "hi"):
        above = (F.col("n1") * F.col(f"{q}1") + PRIOR * F.col(f"{q}2")) / (F.col("n1") + PRIOR)
        out = out.withColumn(q, (F.col("n") * F.col(q) + PRIOR * above) / (F.col("n") + PRIOR))
    cut = []
    for r, (_, slack, lower) in RATES.items():
        hi = F.col("hi") + REACH * (F.col("hi") - F.col("mid")) + slack
        lo = F.col("lo") - REACH * (F.col("mid") - F.col("lo")) - slack if lower else F.lit(None).cast("double")
        cut += [F.max(F.when(F.col("rate") == r, hi)).alias(f"hi_{r}"), F.max(F.when(F.col("rate") == r, lo)).alias(f"lo_{r}")]
    return out.groupBy("lang", "source").agg(*cut)


def judged(df: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``df`` (with ``_q``, best a stored table as it is read twice) with ``_base_failed`` and ``_kept``."""
    cut = small(stored(fences(df, lang_col, source_col), "fences"))
    cut = cut.select(F.struct(*cut.columns).alias("_cut"))
    failed = F.expr("_q.n_words < 20 or 100 * _q.n_repeat_words > 30 * _q.n_words")
    outside = F.lit(False)
    for r in RATES:
        outside |= F.coalesce((_rate(r) > F.col(f"_cut.hi_{r}")) | (_rate(r) < F.coalesce(F.col(f"_cut.lo_{r}"), F.lit(0.0))), F.lit(False))
    verdict = ("_base_failed", "_kept")
    rows = carried(df, F.col("_q"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), without=("_q", *verdict))
    same = F.col("_lang").eqNullSafe(F.col("_cut.lang")) & F.col("_source").eqNullSafe(F.col("_cut.source"))
    return rows.join(cut, same, "left").select("row.*", "_q", failed.alias(verdict[0]), (~failed & ~outside).alias(verdict[1]))
