"""Filter interaction audit: what each filter removes in every order, with duplicates by partition refinement.

One pass over the texts gives each document the mask of filters it fails, its code-point length and hashes
of successive blocks (64 code points, then up to 1,024, 16,384, ...).  Duplicates: documents are
split by length, then by one block's hash after the other, and classes of one document are dropped each
time, until no text left is longer than the blocks read.  The survivors' texts are then compared in
full (grouped by text), and every document whose id is above its class' least is marked.  What
remains is counting masks by part: every order and step follows from at most 2^filters counts a part.

Hot classes: counts are summed before shuffles, and classes of over a thousandth of the rows are broadcast, the
others shuffled, when classes go back to their documents.

Edge cases: null texts count as empty; null parts as the empty string; rows with a null id are neither
duplicates nor what others duplicate, and have no label; equal ids with equal texts are no duplicates of each other; a
document is good (toxic) if any of its label rows says so; an empty table gives an empty one; columns beyond those named
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, rejoined, small, stored

SPACE = r"[\x20\x09-\x0D]"
#: Ends of the blocks in code points; the last is beyond any text.
ENDS = [64 * 16**k for k in range(6)]
ROW = ["part", "mask", "good", "toxic"]


def text_filters() -> dict[str, Column]:
    """The conditions on ``text`` (null-free) and ``words`` (array): A few words, B repetitive, C capitals, D symbols."""
    text, n = F.col("text"), F.size("words")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": n < 100, "B": 100 * F.size(F.array_distinct("words")) < 80 * n, "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _blocks() -> Column:
    """Hashes of a text's blocks, null where it ends before."""
    cut = lambda start, end: F.xxhash64(F.substring("text", start + 1, end - start))
    return F.array(*[F.when(F.length("text") > a, cut(a, b)) for a, b in zip([0, *ENDS[:-1]], ENDS)])


def _chained(blocks: Column, upto: int) -> Column:
    """One hash of the first ``upto`` blocks' hashes."""
    return F.xxhash64(F.slice(blocks, 1, upto)) if upto else F.lit(0).cast("long")


def repeated(rows: DataFrame) -> tuple[DataFrame, int]:
    """Of ``rows`` (length, blocks, ...) those that share length and block hashes with another, with ``chain``, and how many blocks were read."""
    live, upto = rows.withColumn("chain", _chained(F.col("blocks"), 0)), 0
    before = None
    while True:
        n = live.count()
        sizes = live.groupBy("length", "chain").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        live = stored(rejoined(live, sizes, ["length", "chain"], "n", n).drop("n"), "refined")
        if before is not None:
            drop(before)
        before = live
        longest = live.agg(F.max("length")).first()[0]
        if longest is None or longest <= ([0, *ENDS])[upto] or upto == len(ENDS):
            return live, upto
        upto += 1
        live = live.withColumn("chain", _chained(F.col("blocks"), upto))


def _later(texts: DataFrame, live: DataFrame, upto: int) -> DataFrame:
    """Rows (part, mask, good, toxic) of documents whose text a smaller id has too, compared in full.

    ``texts`` holds all documents (id, text, length, blocks and what the rows need), ``live`` the survivors of :func:`repeated`.
    """
    sizes = stored(live.groupBy("length", "chain").agg(F.count(F.lit(1)).alias("n")), "classes")
    n = live.count()
    own = texts.where("id is not null").withColumn("chain", _chained(F.col("blocks"), upto))
    few, narrow = small(sizes), own.select("id", "text", "length", "chain")
    back = narrow.join(few, ["length", "chain"]) if few is not sizes else rejoined(narrow, sizes, ["length", "chain"], "n", n)
    exact = back.groupBy("length", "chain", "text").agg(F.min("id").alias("first"))  # the text itself is the key
    one = stored(exact.groupBy("length", "chain").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).join(sizes, ["length", "chain"]), "firsts")
    out = rejoined(live, one.where("texts = 1"), ["length", "chain"], "n", n).where("id > first")
    mixed = one.where("texts > 1").select("length", "chain")
    if not mixed.isEmpty():  # different texts behind equal hashes: the text goes along
        apart = own.join(mixed, ["length", "chain"], "left_semi").join(exact, ["length", "chain", "text"]).where("id > first")
        out = out.select(*ROW).unionByName(apart.select(*ROW))
    return out.select(*ROW)


def masks(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    filters: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail; bit k is the k-th filter, the bit after them an exact duplicate."""
    filters = text_filters() if filters is None else filters
    mark = lambda c, name: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(mark("quality", "good"), mark("toxic", "toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    words = F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "")
    bits = reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(filters.values())])
    judged = texts.withColumn("words", words).select("id", "part", bits.alias("mask"), F.length("text").alias("length"), _blocks().alias("blocks"), "text")
    marked = lambda df: df.join(marks, "id", "left").fillna(False, ["good", "toxic"])
    narrow = stored(marked(judged.drop("text")), "masks")
    counted = lambda df: df.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n"))
    live, upto = repeated(narrow.where("id is not null"))
    twice = stored(counted(_later(marked(judged), live, upto)), "duplicates")
    moved = twice.withColumn("n", -F.col("n")).unionByName(twice.withColumn("mask", F.col("mask") + (1 << len(filters))))
    out = stored(counted(narrow).unionByName(moved).groupBy(*ROW).agg(F.sum("n").alias("n")).where("n > 0"), "mask_counts")
    drop(narrow, live, twice)
    return out


def audited(counts: DataFrame, letters: Sequence[str]) -> DataFrame:
    """For each part, order of the filters and step: counts of documents, from ``counts`` of :func:`masks`."""
    entry = F.struct("mask", "good", "toxic", "n")
    parts = counts.groupBy("part").agg(F.collect_list(entry).alias("e"))  # 4 * 2^filters entries at most
    orders = F.lit(["".join(p) for p in permutations(letters)])
    out = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    bit = F.create_map(*[F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)])
    at = lambda i: F.element_at(bit, F.substring(F.col("filter_order"), i, F.lit(1)))
    upto = F.aggregate(F.sequence(F.lit(1), "step"), F.lit(0), lambda a, i: a.bitwiseOR(at(i)))
    out = out.withColumn("own", at(F.col("step"))).withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("own"))

    def total(of, times=lambda x: x["n"]) -> Column:
        return F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + F.when(of(x), times(x)).otherwise(F.lit(0).cast("long")))

    fails = lambda x: x["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("before")) != 0
    here = lambda x: fails(x) & ~gone(x)
    every = reduce(lambda a, b: a * b, range(1, len(letters) + 1))
    return out.select(
        "part", "filter_order", "step",
        total(lambda x: x["mask"].bitwiseAND(F.col("upto")) == 0).alias("kept"), total(here).alias("removed"),
        total(lambda x: fails(x) & gone(x)).alias("redundant"), total(lambda x: x["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda x: here(x) & x["good"]).alias("good_lost"), total(lambda x: here(x) & x["toxic"]).alias("toxic_lost"),
        # of the filters that a document fails, each comes first in an equal share of all orders
        total(fails, lambda x: x["n"] * F.floor(F.lit(every) / F.bit_count(x["mask"]))).alias("shapley"),
    )
