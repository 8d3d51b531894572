r"""Information-theoretic sanitisation of personal data (DataFrame functions only).

Base spans (e-mail addresses, IPv4 addresses, card and phone numbers) are the protected entities; every
word of a document that holds one is a candidate term for it.  Over the corpus, n(t, e) is the
number of documents that hold both term t and entity e, n(t) and n(e) of those that hold t or e;
t reveals e as far as P(e | t) = n(t, e) / n(t) exceeds P(e) = n(e) / n, in bits
log2(P(e | t) / P(e)).  Terms that meet the entity in ``SUPPORT`` different texts or more, with
P(e | t) of ``SHARE`` and at least ``BITS_OVER`` bits, exceed the disclosure threshold, and are removed
as spans of kind ``term`` wherever they stand, in documents without the entity as well.

The Java patterns match as the plain ones do, leftmost and without overlaps, but possessively or
anchored at the start of a run, so no text makes them recurse or run in quadratic time:
a run of address characters in which a match fails at its start holds none further right, and all
card candidates are maximal runs of digits with single separators.  Places of n spans come from
prefix sums in n * sqrt(n) steps.

Edge cases: null texts count as empty (no spans); entities compare lower-cased without separators;
repeated rows count as documents alike in n(t, e), n(t) and n(e), but equal texts as one text of
support; rows with null ids take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, drop, small, stored

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
SPAN = "array<struct<kind:string,at:int,to:int,hit:string>>"
WORD = r"[^\x20\x09-\x0D]+"
SUPPORT, SHARE, BITS_OVER = 3, 0.9, 3.0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.when(F.length(F.regexp_replace(p, "^0+", "")) > 3, F.lit(999)).otherwise(F.lit(0))) <= 255
        return F.forall(F.split(hit, r"\."), small)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "card":
        # Luhn: from the right, every second digit is doubled, less 9 if above 9
        turned = F.split(F.reverse(_digits(hit)), "")
        each = F.transform(F.filter(turned, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.when(x.cast("int") > 4, 1).otherwise(0)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.lit(True)


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column, start: int, join) -> Column:
    """For each of an array's ints, ``join`` over those before it: within blocks of sqrt(n), and over blocks."""
    over = lambda a: F.aggregate(a, F.lit(start), join)

    def of(v):
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        blocks = lambda w: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / w).cast("int")), lambda k: over(F.slice(v, k * w + 1, w)))
        firsts = lambda w: _let(blocks(w), lambda b: F.transform(b, lambda _, k: over(F.slice(b, F.lit(1), k))))
        each = lambda w, f: F.transform(v, lambda _, i: join(F.get(f, F.floor(i / w).cast("int")), over(F.slice(v, i - i % w + 1, i % w))))
        return _let(width, lambda w: _let(firsts(w), lambda f: each(w, f)))

    return _let(values, of)


def _located(kind: str, hits: Column, gaps: Column) -> Column:
    """Spans of matches, which alternate with the gaps before them; both give the places."""
    size = lambda x: F.length(x).cast("int")
    both = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("hit"), size(g).alias("gap"), (size(g) + size(h)).alias("len")))

    def placed(x):
        before = _running(F.transform(x, lambda y: y["len"]), 0, lambda a, b: a + b)
        return F.zip_with(x, before, lambda y, n: F.struct(F.lit(kind).alias("kind"), (n + y["gap"]).alias("at"), (n + y["len"]).alias("to"), y["hit"].alias("hit")))

    return F.when(F.size(hits) > 0, _let(both, placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``_base``: spans of all kinds, by kind as listed, then start; code points, end exclusive."""
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))

    def of(kind: str) -> Column:
        return F.filter(_located(kind, F.col(f"_{kind}"), F.split(text, PATTERNS[kind], -1)), lambda s: _valid(kind, s["hit"]))

    return df.withColumn("_base", F.concat(*[of(k) for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], F.when(s["kind"].isin("card", "phone"), _digits(s["hit"])).otherwise(F.lower(s["hit"])))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _terms(some: DataFrame, docs: DataFrame) -> DataFrame:
    """Terms beyond the threshold of any entity, from the rows with entities (row, key, text, entities) and all texts."""
    n = float(max(docs.count(), 1))
    held = some.select("row", "key", F.explode("entities").alias("entity"))
    n_e = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.countDistinct("key").alias("texts"))
    n_e = n_e.where((F.col("texts") >= SUPPORT) & (F.log2(F.lit(n) / F.col("n_e")) >= BITS_OVER)).select("entity", "n_e")
    held = stored(held.join(n_e, "entity"), "entities")
    # n(t, e) is at most n(e) and n(t) at least the rows here, so these bounds drop no pair over the threshold
    most = held.groupBy("row").agg(F.max("n_e").alias("most"))
    word = stored(some.join(most, "row").select("row", "key", "most", F.explode(_words(F.col("text"))).alias("term")), "words")
    term = word.groupBy("term").agg(F.count(F.lit(1)).alias("n_here"), F.countDistinct("key").alias("texts"), F.max("most").alias("most"))
    term = term.where((F.col("texts") >= SUPPORT) & (F.col("most") >= SHARE * F.col("n_here"))).select("term", "n_here")
    met = word.join(term, "term").select("row", "term", "n_here").join(held, "row").where(F.col("n_e") >= SHARE * F.col("n_here"))
    met = met.groupBy("entity", "term", "n_e", "n_here").agg(F.count(F.lit(1)).alias("n_te"), F.countDistinct("key").alias("support"))
    pair = stored(met.where((F.col("support") >= SUPPORT) & (F.col("n_te") >= SHARE * F.col("n_here"))), "pairs")
    drop(held, word)
    terms = stored(pair.select("term").distinct(), "terms")
    n_t = docs.select(F.explode(_words(F.col("text"))).alias("term")).join(small(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    share = F.col("n_te") / F.col("n_t")
    over = F.log2(share / (F.col("n_e") / F.lit(n)))
    out = stored(pair.join(n_t, "term").where((share >= SHARE) & (over >= BITS_OVER)).select("term").distinct(), "revealing")
    drop(pair, terms)
    return out


def _placed(text: Column, terms: Column) -> Column:
    """Spans of all words of ``text`` that are among ``terms``, in order."""
    every = _located("term", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1))
    low = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["at"].alias("at"), s["to"].alias("to"), F.lower(s["hit"]).alias("hit")))
    return F.filter(low, lambda s: F.array_contains(terms, s["hit"]))


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``_spans`` (in place of a column of that name): base spans and then term spans, each by start; the rows' order isn't kept."""
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = carried(df, without=("_spans",))
    own = F.col("row").getField(text_col)
    text, ident = F.coalesce(own, F.lit("")), F.xxhash64(F.col("row").getField(id_col).cast("string"), own)
    found = base_spans(df, text)
    # candidates come from the few rows with spans; the others take no part in their shuffles
    entities = F.array_distinct(F.transform("_base", _entity))
    some = found.where(F.size("_base") > 0).select(F.monotonically_increasing_id().alias("row"), F.xxhash64(own).alias("key"), text.alias("text"), entities.alias("entities"))
    some = stored(some, "holders")
    revealing = _terms(some, docs)
    drop(some)
    if revealing.isEmpty():
        return found.select("row.*", F.col("_base").alias("_spans"))
    hits = df.select(ident.alias("_row"), F.explode(_words(text)).alias("term")).join(small(revealing), "term", "left_semi").groupBy("_row").agg(F.collect_set("term").alias("_terms"))
    hits = small(stored(hits, "hits"), array="_terms")
    # a term inside a base span is covered already
    clear = F.filter(_placed(text, F.col("_terms")), lambda t: ~F.exists("_base", lambda b: (b["at"] < t["to"]) & (t["at"] < b["to"])))
    clear = F.when(F.col("_terms").isNotNull(), clear).otherwise(F.array().cast(SPAN))
    return found.withColumn("_row", ident).join(hits, "_row", "left").select("row.*", F.concat("_base", clear).alias("_spans"))


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` (with ``_spans``) with each span generalised to its mark and revealing terms removed; drops ``_spans``.

    Of spans that overlap, the first gives the mark, and all are cut out.
    """
    text = F.col(text_col)
    in_order = F.array_sort(F.transform("_spans", lambda s: F.struct(s["at"].alias("at"), s["to"].alias("to"), s["kind"].alias("kind"))))
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])

    def cut(spans):
        reach = _running(F.transform(spans, lambda s: s["to"]), 0, lambda a, b: F.greatest(a, b))
        piece = lambda s, at: F.when(s["at"] >= at, F.concat(F.substring(text, at + 1, s["at"] - at), F.element_at(mark, s["kind"]))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.zip_with(spans, reach, piece), ""), F.substring(text, F.array_max(F.transform(spans, lambda s: s["to"])) + 1, F.length(text)))

    return df.withColumn(text_col, F.when(F.size("_spans") > 0, _let(in_order, cut)).otherwise(text)).drop("_spans")
