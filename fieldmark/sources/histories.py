"""Detection histories from files, encounter strings, wide tables or event logs.

A ``CaptureFrame`` is a DataFrame with an id, ``h`` (array of 0/1, one an occasion), ``x`` (captures),
``e`` and ``l`` (first and last occasion from 0; T and -1 if never captured) and covariates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


class DataFormatError(ValueError):
    """Input that no adapter reads, or that breaks a format's rules."""


@dataclass(frozen=True)
class CaptureFrame:
    df: DataFrame
    occasions: int
    names: tuple[str, ...] = ()
    covariates: tuple[str, ...] = ()
    meta: dict = field(default_factory=dict)


def summarised(df: DataFrame, occasions: int, h: str = "h") -> DataFrame:
    """Adds x, e, l; one pass, no shuffle."""
    a = F.col(h)
    return df.withColumns({
        "x": F.aggregate(a, F.lit(0), lambda s, v: s + v),
        "e": F.when(F.array_contains(a, 1), (F.array_position(a, 1) - 1).cast("int")).otherwise(F.lit(occasions)),
        "l": F.when(F.array_contains(a, 1), (F.lit(occasions) - F.array_position(F.reverse(a), 1)).cast("int")).otherwise(F.lit(-1)),
    })


def history_array(ch: Column) -> Column:
    """'0110' -> [0, 1, 1, 0]."""
    return F.transform(F.filter(F.split(ch, ""), lambda c: c != ""), lambda c: c.cast("int"))


def from_strings(df: DataFrame, ch: str = "ch", id_col: str | None = None, check: bool = True) -> CaptureFrame:
    """From a column of encounter strings; all of one length, only 0 and 1."""
    got = df.agg(F.count_if(~F.col(ch).rlike("^[01]+$") | F.col(ch).isNull()).alias("bad"), F.min(F.length(ch)).alias("lo"), F.max(F.length(ch)).alias("hi")).first()
    if check and got["bad"]:
        raise DataFormatError(f"{got['bad']} histories hold other characters than 0 and 1")
    if check and got["lo"] != got["hi"]:
        raise DataFormatError(f"histories have lengths from {got['lo']} to {got['hi']}")
    skip = {ch, id_col, "individual_id", "id", "person_id"}
    out = summarised(df.withColumn("h", history_array(F.col(ch))), got["hi"] or 0)
    return CaptureFrame(out, got["hi"] or 0, covariates=tuple(c for c in df.columns if c not in skip), meta={"adapter": "rmark"})


def wide_array(columns: Sequence[str]) -> Column:
    """Detection indicators of wide numeric columns: above 0 is 1, null is 0."""
    return F.array(*[F.when(F.col(c) > 0, 1).otherwise(0) for c in columns])


def capture_columns(df: DataFrame) -> list[str]:
    """Y<digits> columns if three or more, else numeric columns if three or more."""
    years = sorted(c for c in df.columns if re.fullmatch(r"Y\d+", c))
    if len(years) >= 3:
        return years
    numeric = sorted(f.name for f in df.schema.fields if isinstance(f.dataType, NumericType))
    return numeric if len(numeric) >= 3 else []


def varying_groups(columns: Sequence[str], least: int = 2) -> dict[str, list[str]]:
    """Time-varying covariates by name pattern (base_2016, base.2016, base2016), each sorted by year."""
    found: dict[str, list[tuple[int, str]]] = {}
    for c in columns:
        if m := re.fullmatch(r"(.+?)[_.]?((?:19|20)\d\d|\d{1,2})", c):
            if m[1] != "Y" and ("_" in c or "." in c or len(m[2]) == 4):
                found.setdefault(m[1], []).append((int(m[2]), c))
    return {b: [c for _, c in sorted(v)] for b, v in found.items() if len(v) >= least}


def from_wide(df: DataFrame, captures: Sequence[str] | None = None, covariates: Sequence[str] | None = None, id_col: str | None = None, varying: bool = True) -> CaptureFrame:
    """From one column an occasion; groups such as age_1, age_2 become array covariates."""
    captures = sorted(captures) if captures else capture_columns(df)
    if missing := [c for c in captures if c not in df.columns]:
        raise DataFormatError(f"capture columns {missing} are missing")
    if len(captures) < 3:
        raise DataFormatError("fewer than three capture columns")
    groups = {b: v for b, v in varying_groups([c for c in df.columns if c not in captures]).items() if b not in df.columns} if varying else {}
    out = df.withColumns({b: F.array(*[F.col(c).cast("double") for c in v]) for b, v in groups.items()}) if groups else df
    out = summarised(out.withColumn("h", wide_array(captures)), len(captures))
    taken = {*captures, id_col, *[c for v in groups.values() for c in v]}
    covs = tuple(covariates) if covariates else tuple(c for c in df.columns if c not in taken) + tuple(groups)
    return CaptureFrame(out, len(captures), tuple(captures), covs, {"adapter": "generic", "varying": groups})


def from_events(individuals: DataFrame, events: DataFrame, id_col: str, occasion: Column, occasions: Sequence, event_id: str | None = None, measures: dict[str, Column] | None = None) -> CaptureFrame:
    """From a log: an individual is captured in an occasion with an event or more.

    Events are reduced to one row an individual (combined before the shuffle), then joined to all
    individuals, so those never seen stay.  ``measures`` are aggregates per occasion, as arrays.
    """
    keyed = events.withColumn("_occ", occasion)
    at = lambda t: F.col("_occ") == F.lit(t)
    aggs = [F.array(*[F.max(F.when(at(t), 1).otherwise(0)) for t in occasions]).alias("_h")]
    for name, (how, value) in (measures or {}).items():
        aggs.append(F.array(*[how(F.when(at(t), value)) for t in occasions]).alias(name))
    seen = keyed.groupBy(F.col(event_id or id_col).alias("_id")).agg(*aggs)
    none = F.array(*[F.lit(0)] * len(occasions))
    df = individuals.join(seen, F.col(id_col) == F.col("_id"), "left").withColumn("h", F.coalesce("_h", none)).drop("_id", "_h")
    blank = F.array(*[F.lit(None).cast("double")] * len(occasions))
    for name in measures or {}:
        df = df.withColumn(name, F.coalesce(F.col(name).cast("array<double>"), blank))
    df = df.withColumn("ch", F.array_join("h", ""))
    return CaptureFrame(summarised(df, len(occasions)), len(occasions), tuple(map(str, occasions)), tuple(individuals.columns) + tuple(measures or {}))


def windowed(frame: CaptureFrame, first: Column, last: Column, arrays: Sequence[str] = ()) -> CaptureFrame:
    """Only what lies in an individual's own window of occasions (from 0, ends included) counts; ``arrays`` are null outside."""
    inside = lambda i: (i >= first) & (i <= last)
    cut = {"h": F.transform("h", lambda v, i: F.when(inside(i), v).otherwise(0))}
    cut |= {c: F.transform(c, lambda v, i: F.when(inside(i), v)) for c in arrays}
    df = frame.df.withColumns(cut).drop("x", "e", "l").withColumn("ch", F.array_join("h", ""))
    return CaptureFrame(summarised(df, frame.occasions), frame.occasions, frame.names, frame.covariates, frame.meta)


# --- adapters: the first whose test accepts the schema reads it; new ones go first -------------------

Adapter = tuple[str, Callable[[DataFrame], bool], Callable[..., CaptureFrame]]
_ADAPTERS: list[Adapter] = [
    ("rmark", lambda df: "ch" in df.columns, from_strings),
    ("generic", lambda df: len(capture_columns(df)) >= 3, from_wide),
]


def register_adapter(name: str, accepts: Callable[[DataFrame], bool], read: Callable[..., CaptureFrame]) -> None:
    _ADAPTERS.insert(0, (name, accepts, read))


def detect_adapter(df: DataFrame) -> Adapter:
    for adapter in _ADAPTERS:
        if adapter[1](df):
            return adapter
    raise DataFormatError(f"no adapter reads columns {df.columns}")


def to_frame(df: DataFrame, adapter: str | None = None, **options) -> CaptureFrame:
    if adapter is None:
        return detect_adapter(df)[2](df, **options)
    for name, _, read in _ADAPTERS:
        if name == adapter:
            return read(df, **options)
    raise DataFormatError(f"unknown adapter {adapter!r}")


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV, JSON, ORC, Parquet or encounter files (``.inp``, as individuals) by suffix.  CSV columns named ``ch`` stay text, so zeros lead."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        head = spark.read.csv(path, header=True, **options)
        schema = spark.read.csv(path, header=True, inferSchema=True, samplingRatio=options.pop("samplingRatio", 1.0), **options).schema
        return head.select(*[head[f.name] if f.name == "ch" else head[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
    if kind in ("parquet", "json", "orc"):
        return spark.read.format(kind).options(**options).load(path)
    if kind in ("xlsx", "xls"):
        import pandas as pd  # a spreadsheet is one small file; needs a reader such as openpyxl

        return spark.createDataFrame(pd.read_excel(path, dtype={"ch": str}))
    if kind == "inp":
        from fieldmark.sources.encounters import individuals, read_encounters

        groups = tuple(options.get("groups", ("n",)))
        return individuals(read_encounters(spark, path, **options), groups)
    raise DataFormatError(f"can't read files of kind {kind!r}")


def load(spark: SparkSession, path: str, adapter: str | None = None, id_col: str | None = None, **options) -> CaptureFrame:
    return to_frame(read_table(spark, path, **options), adapter, **({"id_col": id_col} if id_col else {}))


def load_sampled(spark: SparkSession, path: str, n: int, tier_columns: Sequence[str] | None = None, share: float = 0.5, validation: float | None = None, id_col: str | None = None, seed: int = 42) -> tuple[CaptureFrame, CaptureFrame | None]:
    """A stratified sample of a file's individuals (by whether they ever reach tier 2), and of it a validation part if asked for."""
    from fieldmark.operators import sampling

    frame = load(spark, path, id_col=id_col)
    key = id_col or "id"
    tiers = list(tier_columns) if tier_columns is not None else sampling.tier_columns(frame.df)
    ever = sampling.ever_tier(tiers)
    part = lambda df: CaptureFrame(df, frame.occasions, frame.names, frame.covariates)
    drawn = sampling.stratified(frame.df, n, ever, share, key, seed)
    if validation is None:
        return part(drawn), None
    split = sampling.train_validation(drawn, validation, ever, key, seed)
    return part(split.where("not validation").drop("validation")), part(split.where("validation").drop("validation"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def export(df: DataFrame, path: str, kind: str = "csv", digits: int = 6, mode: str = "errorifexists") -> None:
    """Results with rounded numbers as CSV, JSON or Parquet."""
    out = rounded(df, digits).write.mode(mode)
    (out.option("header", True).csv if kind == "csv" else getattr(out, kind))(path)


def export_stamped(df: DataFrame, folder: str, prefix: str = "results", kind: str = "csv", digits: int = 6) -> str:
    from datetime import datetime, timezone

    path = f"{folder.rstrip('/')}/{prefix}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    export(df, path, kind, digits)
    return path
