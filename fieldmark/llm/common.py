"""Shared plumbing: tables in the cluster's shared folder, binary columns, bucket counts."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; numpy scratch space is about 40 times this.
CHUNK_BYTES = 1 << 20
#: Most text of a unit, and most text whose hashes fall into a range, on average.
UNIT_BYTES, RANGE_BYTES = 32 << 20, 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, the warehouse's (both are shared)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return path or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_fieldmark"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def carried(df: DataFrame, *more: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """``df``'s columns as one struct ``row``, beside columns ``more``: whatever names the input has, they clash with none of an operator's.

    Columns named in ``without``, those that the operator returns, stay behind.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without]).alias("row"), *more)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote, once nothing reads them any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.stored_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def dealt(df: DataFrame, text_col: str, *range_bytes: int) -> tuple[int, ...]:
    """(units, ranges): how many units texts are dealt to, and how many hash ranges units exchange hashes with.

    Both follow the shuffle partitions the cluster is set to, and more of them where a unit would
    hold over ``UNIT_BYTES`` of text on average or a range the hashes of over ``RANGE_BYTES`` (or of each of
    ``range_bytes``, one number of ranges for each), so that what a task holds stays bounded whatever the setting.  A unit sends a range one row at
    most, and none without hashes, so rows are fewer than hashes.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(2 * parts, -(-size // UNIT_BYTES)), *(max(4, parts // 2, -(-size // b)) for b in range_bytes or (RANGE_BYTES,))


def small(df: DataFrame, rows: int = 20_000, array: str | None = None) -> DataFrame:
    """A stored table of narrow rows, marked for broadcasting if it is counted to have ``rows`` at most,
    and ten times as many entries at most in a column ``array``."""
    n, entries = df.agg(F.count(F.lit(1)), F.sum(F.size(array)) if array else F.lit(0)).first()
    return F.broadcast(df) if n <= rows and (entries or 0) <= 10 * rows else df


def rejoined(left: DataFrame, right: DataFrame, on: list[str], weight: str, rows: int, share: int = 1000) -> DataFrame:
    """``left`` joined (null-safe) with ``right``, a row a key, whose ``weight`` is the number of rows of ``left`` with the key.

    ``rows`` is the sum of weights.  Keys of over ``rows / share`` rows, fewer than ``share`` of them by that sum, are
    broadcast, so no hot key meets in one task; the others are shuffled.  Rows without a key in ``right`` go.
    """
    hot = F.col(weight) * share > rows
    key = [F.col(c).alias(f"{c}__r") for c in on]
    rest = [c for c in right.columns if c not in on]
    same = lambda: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}__r")) for c in on])
    keyed = right.select(*key, *rest)
    few = F.broadcast(keyed.where(hot))  # fewer than share rows
    common = left.join(few, same())
    others = left.join(few, same(), "left_anti").join(keyed.where(~hot), same())
    return common.unionByName(others).drop(*[f"{c}__r" for c in on])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash range of each 64-bit hash; monotone in the hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def unpack(scalar, dtype) -> np.ndarray:
    """A binary cell as a numpy array."""
    buf = scalar.as_buffer() if isinstance(scalar, pa.Scalar) else scalar
    return np.frombuffer(buf, dtype) if buf is not None else np.empty(0, dtype)


def cells(column, dtype) -> list[np.ndarray]:
    """The binary cells of an Arrow column as numpy arrays."""
    if isinstance(column, pa.ChunkedArray):
        return [a for c in column.chunks for a in cells(c, dtype)]
    return [unpack(column[i], dtype) for i in range(len(column))]


def chunks(text: pa.Array, limit: int = CHUNK_BYTES):
    """(start, stop) row ranges of about ``limit`` bytes; a longer text stands alone."""
    off = offsets_of(text)
    start = 0
    while start < len(text):
        stop = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(text))
        yield start, stop
        start = stop


def offsets_of(text: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    raw = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)
    return raw[text.offset : text.offset + len(text) + 1].astype(np.int64)


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a null-free column end to end, and the offsets of each."""
    if len(text) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = offsets_of(text)
    buf = text.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.empty(0, np.uint8)
    return data, off - off[0]
