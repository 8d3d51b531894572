"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Sources share the total size by weight; a target stops at ``cap`` times its source's size, and the
excess is shared anew until none is above (a water level over sources ordered by cap / weight).  A
source's documents are taken whole as many times as its target holds its size; for the rest, those
whose hash lies under a threshold are taken once more.  The threshold comes from histograms of size
by source and leading hash bits; only the bucket where the budget runs out is refined by the next
bits, until it holds one hash, which goes in if that brings the source nearer to its target.

Edge cases: null texts have size 0; null sources are one source, the last; null ids hash as empty;
rows with equal id and text share a hash and are taken alike; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, small, stored

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVEL = 60, 12


def targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = Window.orderBy(F.col("source").asc_nulls_last())  # over the sources, a small table
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(nth) - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    full = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    src = src.withColumn("level", (F.sum("source_size").over(every) - gone("top")) / (F.sum("w").over(every) - gone("w")))
    src = src.withColumn("order", F.row_number().over(full))
    src = src.withColumn("level", F.min_by("level", F.when(F.col("top") / F.col("w") >= F.col("level"), F.col("order"))).over(every))
    return src.select("source", "source_size", F.least(F.col("top"), F.col("w") * F.col("level")).alias("target"))


def _thresholds(sizes: DataFrame, src: DataFrame) -> DataFrame:
    """``src`` with ``below``: hashes under it are in for the rest of the budget."""
    src = stored(src, "sources")
    edge = sizes.join(src.where("rest > 0").select(F.col("source").alias("s"), F.col("rest").alias("left")), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "hash", "left")
    done = None
    for level in range(1, BITS // LEVEL + 1):
        shift = BITS - level * LEVEL
        cell = F.shiftright("hash", shift)
        hist = edge.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("sum"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.first("left").alias("left"))
        run = Window.partitionBy("source").orderBy("cell")  # at most 2**LEVEL cells a source
        hist = hist.withColumn("up", F.sum("sum").over(run)).withColumn("before", F.col("up") - F.col("sum"))
        # the last cell wholly or partly inside the budget
        at = stored(hist.where("before < left").groupBy("source").agg(F.max_by(F.struct("cell", "before", "up", "lo", "hi", "left"), "cell").alias("c")), "edge").select("source", "c.*")
        last = F.lit(shift == 0)
        whole = F.col("up") <= F.col("left")
        single = (F.col("lo") == F.col("hi")) | last
        nearer = (F.col("up") - F.col("left")) <= (F.col("left") - F.col("before"))
        settled = at.where(whole | single).select("source", F.when(whole | nearer, F.col("hi") + 1).otherwise(F.col("lo")).alias("below"))
        done = settled if done is None else done.unionByName(settled)
        open_ = at.where(~(whole | single)).select(F.col("source").alias("s"), F.col("cell").alias("c"), (F.col("left") - F.col("before")).alias("rem"))
        if open_.isEmpty():
            break
        same = F.col("source").eqNullSafe(F.col("s")) & (cell == F.col("c"))
        edge = stored(edge.join(open_, same).select("source", "size", "hash", F.col("rem").alias("left")), "edge")
    done = done.select(F.col("source").alias("s"), "below")
    return src.join(done, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(df: DataFrame, keep: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Columns ``keep`` (default all) of ``df`` and a struct ``_mix`` (in place of a column of that name): size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the row, ``taken`` its size times that.
    """
    size: Column = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text_col, F.lit("")))
    sha = F.conv(F.substring(F.md5(named), 1, BITS // 4), 16, 10).cast("long")
    left = tuple(c for c in df.columns if keep is not None and c not in keep)
    rows = carried(df, F.struct(F.col(source_col).alias("source"), size.alias("size"), sha.alias("hash")).alias("_m"), without=(*left, "_mix"))
    rows = stored(rows, "sizes")
    sizes = rows.select("_m.*")
    src = targets(sizes, weights, cap)
    fits = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    src = src.withColumn("fits", fits).withColumn("rest", F.when(F.col("fits") < cap, F.col("target") - F.col("fits") * F.col("source_size")).otherwise(0.0))
    src = stored(_thresholds(sizes, src), "thresholds")
    src = small(src).select(F.struct(*src.columns).alias("_src"))
    copies = F.col("_src.fits") + F.coalesce((F.col("_m.hash") < F.col("_src.below")).cast("long"), F.lit(0))
    out = F.struct(F.col("_m.size").alias("size"), F.col("_src.source_size").alias("source_size"), F.col("_src.target").alias("target"), copies.alias("copies"), (copies * F.col("_m.size")).alias("taken"))
    return rows.join(src, F.col("_m.source").eqNullSafe(F.col("_src.source"))).select("row.*", out.alias("_mix"))
