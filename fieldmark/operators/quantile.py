"""Exact quantiles of large columns by refined histograms.

A first scan counts values by sign and power of two; the cell in which a wanted rank falls is cut into equal
widths between the least and greatest value found there, and counted again, until it holds few rows or one value.  The last
few rows are fetched.  Each scan is one aggregate with map-side combine of at most ``CELLS`` cells a rank, so no
task and no shuffle holds the column, however it is distributed: a billion well-spread values take three scans,
and doubles run out of bits after six at most.

Nulls take no part; NaN counts as the greatest value, as in Spark's own order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4096
#: Rows that are fetched rather than counted again.
FEW = 10_000


@dataclass(frozen=True)
class Summary:
    """Of a column with counts: rows, mean, standard deviation (over n), least, most, and the quantiles asked for."""

    n: int
    mean: float | None
    sd: float | None
    least: float | None
    most: float | None
    quantiles: dict[float, float | None]


def _power() -> Column:
    """Cell of ``v`` by sign and power of two, in the order of the values."""
    size = F.floor(F.log2(F.abs("v"))).cast("int") + 1100
    special = F.when(F.isnan("v"), 9000).when(F.abs("v") == float("inf"), F.signum("v").cast("int") * 8000)
    return special.when(F.col("v") == 0, 0).when(F.col("v") > 0, size).otherwise(-size).cast("int")


def _width(low: float, high: float) -> Column:
    """Cell of ``v`` among equal widths from ``low`` to ``high``."""
    at = F.floor((F.col("v") - F.lit(low)) / F.lit(high - low) * F.lit(float(CELLS))).cast("int")
    return F.greatest(F.lit(0), F.least(at, F.lit(CELLS - 1)))


def _located(cells: list, ranks: Sequence[int], before: int) -> tuple[dict[int, float], dict[tuple[float, float], tuple[int, list[int], int]]]:
    """Ranks found in cells of one value; others by (least, most) of their cell: weight before it, ranks, rows."""
    found: dict[int, float] = {}
    left: dict[tuple[float, float], tuple[int, list[int], int]] = {}
    cells, at = sorted(cells, key=lambda r: r["cell"]), before
    for r in cells:
        inside = [k for k in ranks if at <= k < at + r["w"]]
        for k in inside:
            if r["lo"] == r["hi"] or math.isnan(r["lo"]):
                found[k] = r["lo"]
            else:
                left.setdefault((r["lo"], r["hi"]), (at, [], r["n"]))[1].append(k)
        at += r["w"]
    return found, left


def summary(df: DataFrame, value: Column, qs: Sequence[float] = (), weight: Column | None = None) -> Summary:
    """Moments and exact quantiles (linear between neighbouring values) of ``value``, counted ``weight`` times."""
    rows = df.select(value.cast("double").alias("v"), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    rows = rows.where("v is not null and w > 0").persist()
    try:
        count = [F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")]
        sums = [F.sum(F.col("v") * F.col("w")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("w")).alias("ss")]
        cells = rows.groupBy(_power().alias("cell")).agg(*count, *sums).collect()  # some 4,200 powers of two at most
        if not cells:
            return Summary(0, None, None, None, None, dict.fromkeys(qs))
        total = sum(r["w"] for r in cells)
        mean, square = (sum(r[c] for r in sorted(cells, key=lambda r: abs(r[c]))) / total for c in ("s", "ss"))
        sd = math.sqrt(max(square - mean * mean, 0.0)) if math.isfinite(mean) else math.nan
        ends = min(cells, key=lambda r: r["cell"])["lo"], max(cells, key=lambda r: r["cell"])["hi"]
        ranks = sorted({k for q in qs for k in (math.floor(q * (total - 1)), math.ceil(q * (total - 1)))})
        found, left = _located(cells, ranks, 0)
        few: dict[tuple[float, float], tuple[int, list[int], int]] = {}
        while left:
            few |= {k: v for k, v in left.items() if v[2] <= FEW}
            wide = {k: v for k, v in left.items() if v[2] > FEW}
            left = {}
            if wide:
                which = [(F.col("v").between(*k), F.struct(F.lit(i).alias("i"), _width(*k).alias("c"))) for i, k in enumerate(wide)]
                at = F.coalesce(*[F.when(c, s) for c, s in which])
                cells = rows.select("v", "w", at.alias("at")).where("at is not null").groupBy(F.col("at.i").alias("i"), F.col("at.c").alias("cell")).agg(*count).collect()  # CELLS a rank
                for i, (before, wanted, _) in enumerate(wide.values()):
                    more, rest = _located([r for r in cells if r["i"] == i], wanted, before)
                    found |= more
                    left |= rest
        if few:
            inside = F.lit(False)
            for low, high in few:
                inside = inside | F.col("v").between(low, high)
            kept = sorted(rows.where(inside).groupBy("v").agg(F.sum("w").alias("w")).collect(), key=lambda r: r["v"])  # FEW a rank
            for (low, high), (before, wanted, _) in few.items():
                at = before
                for r in (r for r in kept if low <= r["v"] <= high):
                    found |= {k: r["v"] for k in wanted if at <= k < at + r["w"]}
                    at += r["w"]
        out = {}
        for q in qs:
            place = q * (total - 1)
            low, high = math.floor(place), math.ceil(place)
            out[q] = found[low] if low == high or found[low] == found[high] else (high - place) * found[low] + (place - low) * found[high]
        return Summary(total, mean, sd, *ends, out)
    finally:
        rows.unpersist()


def quantiles(df: DataFrame, value: Column, qs: Sequence[float], weight: Column | None = None) -> list[float | None]:
    """Exact quantiles of a column; null where it has no values."""
    found = summary(df, value, qs, weight).quantiles
    return [found[q] for q in qs]


def median(df: DataFrame, value: Column) -> float | None:
    return quantiles(df, value, [0.5])[0]
