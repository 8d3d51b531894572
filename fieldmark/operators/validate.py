"""Checks of histories and values, each one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.histories import DataFormatError


def history_report(df: DataFrame, ch: str = "ch") -> DataFrame:
    """One row: n, malformed, lengths (distinct), shortest, longest."""
    c = F.col(ch)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~c.rlike("^[01]+$") | c.isNull()).alias("malformed"),
        F.countDistinct(F.length(c)).alias("lengths"), F.min(F.length(c)).alias("shortest"), F.max(F.length(c)).alias("longest"),
    )


def matrix_report(df: DataFrame, h: str = "h") -> DataFrame:
    """One row: n, occasions (least, most), cells other than 0 and 1, captures, individuals never captured."""
    a = F.col(h)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size(a)).alias("least"), F.max(F.size(a)).alias("most"),
        F.count_if(F.exists(a, lambda v: v.isNull() | ~v.isin(0, 1))).alias("not_binary"),
        F.sum(F.aggregate(a, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))).alias("captures"),
        F.count_if(~F.array_contains(a, 1)).alias("never"),
    )


def value_report(df: DataFrame, column: str) -> DataFrame:
    """One row: n, nulls, negative, not_positive, outside [0, 1], least, most."""
    v = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v < 0).alias("negative"), F.count_if(v <= 0).alias("not_positive"),
        F.count_if((v < 0) | (v > 1)).alias("not_probability"), F.min(v).alias("least"), F.max(v).alias("most"),
    )


def require_histories(df: DataFrame, h: str = "h", occasions: int = 3) -> list[str]:
    """Raises on data that can't be fitted; returns warnings."""
    r = matrix_report(df, h).first()
    if not r["n"]:
        raise DataFormatError("no individuals")
    if r["least"] != r["most"]:
        raise DataFormatError("histories of different lengths")
    if r["least"] < occasions:
        raise DataFormatError(f"{r['least']} occasions; at least {occasions} are needed")
    if r["not_binary"]:
        raise DataFormatError(f"{r['not_binary']} histories with values other than 0 and 1")
    if not r["captures"]:
        raise DataFormatError("nothing was ever captured")
    return [f"{r['never']} individuals were never captured"] if r["never"] else []


def fingerprint(df: DataFrame, id_col: str = "id", ch: str = "ch") -> DataFrame:
    """One row: a digest of all individuals and their histories, whatever their order.

    Count, sum and exclusive or of 60 hash bits a row merge before the shuffle.
    """
    text = F.concat_ws(":", F.col(id_col).cast("string"), F.col(ch))
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return one.select(F.substring(F.md5(F.concat_ws("/", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))), 1, 16).alias("fingerprint"), "n")
