"""Rank correlations of large tables by inversion counts.

Equal pairs are counted once with their number.  Both columns are cut at approximate quantiles into cells of ranges and of
single frequent values.  Pairs of rows from different cells of both columns follow from a histogram of cells; pairs
within one range of the first column and those within one range of the second are counted in tasks, by a
merge over sorted rows.  A value that many rows share is a cell of its own, in which no two rows are out of
order, so it is never brought together.  Average ranks come from running sums within ranges, and the ranges' totals.

A task holds a range of about ``ROWS`` rows, and more only beyond ``ROWS * MOST`` different pairs; the driver holds the
histogram.  Rows with a null or NaN in either column take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, MOST = 200_000, 512


def inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w_i * w_j over pairs with x_i < x_j and y_i > y_j, by bottom-up merges."""
    order = np.lexsort((y, x))
    rank = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    w = w[order].astype(np.int64)
    if int(w.sum()) ** 2 >= 1 << 62:
        w = w.astype(object)
    n, most = len(rank), int(rank.max(initial=0)) + 1
    at, total, size = np.arange(n), 0, 1
    while size < n:
        block, right = at // (2 * size), (at // size) % 2 == 1
        left = block[~right] * most + rank[~right]
        sort = np.argsort(left, kind="stable")
        left, run = left[sort], np.concatenate([[0], np.cumsum(w[~right][sort])])
        own = block[right]
        above = run[np.searchsorted(left, (own + 1) * most)] - run[np.searchsorted(left, own * most + rank[right], "right")]
        total += int((above * w[right]).sum())
        size *= 2
    return total


def _cell(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Odd for a cut's own value, even for the range before it."""
    at = np.searchsorted(cuts, v)
    hit = at < len(cuts)
    hit[hit] = cuts[at[hit]] == v[hit]
    return (2 * at + hit).astype(np.int32)


def _within(rows: DataFrame, cell: str, x: str, y: str) -> int:
    """Inversions between rows of the same range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # as text: a count of pairs may pass 64 bits
        return pd.DataFrame({"k": [str(inversions(pdf[x].to_numpy(), pdf[y].to_numpy(), pdf["w"].to_numpy()))]})

    counted = rows.where(F.col(cell) % 2 == 0).groupBy(cell).applyInPandas(run, "k string")
    return int(counted.agg(F.coalesce(F.sum(F.col("k").cast("decimal(38,0)")), F.lit(0))).first()[0])


def _crossed(counts: pd.DataFrame, cells: int) -> int:
    """Inversions between rows of different cells in both columns."""
    kind = np.int64 if int(counts["w"].sum()) ** 2 < 1 << 62 else object
    h = np.zeros((cells, cells), kind)
    h[counts["p"], counts["c"]] = counts["w"].astype(kind)
    later = np.zeros((cells + 1, cells + 1), kind)  # rows of cells from p on, and below c
    later[:-1, 1:] = h[::-1].cumsum(0)[::-1].cumsum(1)
    return int((h * later[1:, :-1]).sum())


def _tied(rows: DataFrame, *by: str) -> int:
    w = F.col("w").cast("decimal(38,0)")
    return int(rows.groupBy(*by).agg(F.sum("w").alias("w")).agg(F.coalesce(F.sum(w * (w - 1) / 2), F.lit(0))).first()[0])


def _ranked(rows: DataFrame, value: str, cell: str, totals: pd.Series, out: str) -> DataFrame:
    """``rows`` with average ranks of ``value``."""
    before = totals.cumsum() - totals
    spark = rows.sparkSession
    single = [(int(k), float(before[k] + (totals[k] + 1) / 2)) for k in totals.index if k % 2]
    starts = F.broadcast(spark.createDataFrame([(int(k), int(before[k])) for k in totals.index], "cell int, before long"))  # a row a cell
    singles = F.broadcast(spark.createDataFrame(single, f"cell int, {out} double"))  # a row a cut
    odd = rows.where(F.col(cell) % 2 == 1).join(singles, F.col(cell) == F.col("cell")).drop("cell")
    even = rows.where(F.col(cell) % 2 == 0)
    each = even.groupBy(cell, value).agg(F.sum("w").alias("_w"))
    up = F.sum("_w").over(Window.partitionBy(cell).orderBy(value))
    each = each.join(starts, F.col(cell) == F.col("cell")).select(cell, value, (F.col("before") + up - (F.col("_w") - 1) / 2).cast("double").alias(out))
    return even.join(each, [cell, value]).unionByName(odd)


def rank_counts(df: DataFrame, a: Column, b: Column, rows_a_task: int = ROWS) -> dict[str, float | int | None]:
    """n, pairs, concordant, discordant, ties_a, ties_b, rho (Spearman) and exact (share of rows with equal ranks)."""
    ok = df.select(a.cast("double").alias("a"), b.cast("double").alias("b")).where("a is not null and b is not null and not isnan(a) and not isnan(b)")
    pairs = ok.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")).persist()
    try:
        different = pairs.count()
        if not different:
            return {"n": 0, "pairs": 0, "concordant": 0, "discordant": 0, "ties_a": 0, "ties_b": 0, "rho": None, "exact": None}
        parts = min(MOST, -(-different // rows_a_task))
        at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        cuts = [np.array([]), np.array([])]
        if parts > 1:
            cuts = [np.unique(np.array(v) + 0.0) for v in pairs.agg(*[F.percentile_approx(c, at, F.lit(20 * parts)) for c in ("a", "b")]).first()]
        cells = 2 * max(map(len, cuts)) + 1

        def place(batches):
            for pdf in batches:
                yield pdf.assign(p=_cell(pdf["a"].to_numpy(), cuts[0]), c=_cell(pdf["b"].to_numpy(), cuts[1]))

        rows = pairs.mapInPandas(place, "a double, b double, w long, p int, c int").persist()
        counts = rows.groupBy("p", "c").agg(F.sum("w").alias("w")).toPandas()  # cells squared at most
        n = int(counts["w"].sum())
        discordant = _crossed(counts, cells) + _within(rows, "p", "a", "c") + _within(rows, "c", "a", "b")
        ties_a, ties_b, both = _tied(rows, "a"), _tied(rows, "b"), _tied(rows, "a", "b")
        total = n * (n - 1) // 2
        ranked = _ranked(_ranked(rows, "a", "p", counts.groupby("p")["w"].sum(), "ra"), "b", "c", counts.groupby("c")["w"].sum(), "rb")
        x, y, w = F.col("ra") - (n + 1) / 2, F.col("rb") - (n + 1) / 2, F.col("w")
        rho = F.try_divide(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y)))
        got = ranked.agg(rho, F.sum(F.when(F.col("ra") == F.col("rb"), w).otherwise(0)) / n).first()
        rows.unpersist()
        return {
            "n": n, "pairs": total, "concordant": total - discordant - ties_a - ties_b + both, "discordant": discordant,
            "ties_a": ties_a, "ties_b": ties_b, "rho": got[0], "exact": got[1],
        }
    finally:
        pairs.unpersist()
