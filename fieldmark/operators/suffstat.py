"""Grouped sufficient statistics, empirical rates and starting values.

With parameters constant over time an individual matters only through (x, e, l) and its design
columns, so one partial-and-final aggregate compresses any number of rows without loss.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(occasions: int, h: str) -> tuple[Column, Column]:
    """Captures followed by one at the next occasion, and captures that could be."""
    a = F.col(h)
    again = F.aggregate(F.zip_with(F.slice(a, 1, occasions - 1), F.slice(a, 2, occasions - 1), lambda x, y: x * y), F.lit(0), lambda s, v: s + v)
    return again, F.aggregate(F.slice(a, 1, occasions - 1), F.lit(0), lambda s, v: s + v)


def compressed(df: DataFrame, design: Sequence[tuple[str, Column]] = (), occasions: int | None = None, h: str = "h") -> DataFrame:
    """(x, e, l, design columns, n); with ``occasions`` also ``again`` and ``before``, from which survival can be guessed."""
    sums = [F.sum(c).alias(k) for k, c in zip(("again", "before"), runs(occasions, h))] if occasions else []
    return df.groupBy("x", "e", "l", *[c.alias(name) for name, c in design]).agg(F.count(F.lit(1)).alias("n"), *sums)


def rates_of(grouped: pd.DataFrame, occasions: int) -> dict[str, float]:
    """:func:`empirical` of grouped rows."""
    n, before = float(grouped["n"].sum()), float(grouped["before"].sum())
    late = float(grouped.loc[(grouped["e"] >= 1) & (grouped["x"] > 0), "n"].sum())
    return {
        "detection": float((grouped["x"] * grouped["n"]).sum()) / (n * occasions), "survival": float(grouped["again"].sum()) / before if before else 0.8,
        "recruitment": max(0.01, late / (occasions - 1) / n),
    }


def empirical(df: DataFrame, occasions: int, h: str = "h") -> DataFrame:
    """One row: individuals, detection (mean of the matrix), survival (seen again at once), recruitment."""
    again, first = runs(occasions, h)
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n"),
        (F.sum("x") / (n * F.lit(float(occasions)))).alias("detection"),
        F.coalesce(F.try_divide(F.sum(again).cast("double"), F.sum(first).cast("double")), F.lit(0.8)).alias("survival"),
        F.greatest(F.lit(0.01), F.count_if((F.col("e") >= 1) & (F.col("x") > 0)) / F.lit(float(occasions - 1)) / n).alias("recruitment"),
    )


def starting_values(row, names: Sequence[tuple[str, str]]) -> list[float]:
    """For coefficients (parameter, term): intercepts from the empirical rates, others 0.1; without intercept all from the rate."""
    clip = lambda v: min(max(v, 0.01), 0.99)
    logit = lambda v: math.log(clip(v) / (1 - clip(v)))
    rate = {"phi": logit(row["survival"]), "p": logit(row["detection"]), "f": math.log(min(max(row["recruitment"], 0.01), 9.0))}
    out: list[float] = []
    held = {k for k, t in names if t == "(Intercept)"}
    for k, t in names:
        out.append(0.1 if k in held and t != "(Intercept)" else rate.get(k, 0.0))
    return out
