"""Vector code compression: product codes of integer vectors by weighted Lloyd over distinct parts.

Components become integers, vectors are cut into equal parts, and equal parts of a position are counted once
with the number of vectors that hold them, so a part that a third of all vectors share costs one
row.  Each round assigns the distinct parts to the nearest entry of their position's codebook and
replaces entries by floored weighted means; a task sends one sum an entry and component, so the driver
gets a codebook's size a round, whatever the number of vectors.  Codes and errors go back to the vectors
by a join on (position, part); parts of over a thousandth of all are few and broadcast, the others shuffled.
Distances are exact integers.

Edge cases: vectors that are null, empty, or hold null or non-finite components are dropped, and so are those whose
length isn't that of the smallest kept id's vector, or isn't a multiple of ``parts``; repeated rows and ids each count, equal
ids in the vectors' order; null ids come last; fewer vectors than entries give fewer entries; null labels are one label; an empty
table gives an empty one; columns beyond the three named are ignored, whatever their names.  Components so large that
distances pass 64 bits are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, rejoined, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts handled at once; scratch space is this times the entries, in doubles.
BLOCK = 4096


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite components."""
    y = np.floor(x.astype(np.float64) * scale)
    if len(y) and np.abs(y).max() >= 2.0**31:
        raise OverflowError("components of 2^31 or more after scaling have distances beyond 64 bits")
    return y.astype(np.int64)


def packed(part: np.ndarray) -> bytes:
    """A part as bytes in the narrowest width that holds it, so equal parts have equal bytes."""
    top = int(max(part.max(), -1 - part.min()))
    return part.astype("<i2" if top < 1 << 15 else "<i4").tobytes()


def unpacked(cells: list[bytes], width: int) -> np.ndarray:
    """(cells, width) integers."""
    out = np.empty((len(cells), width), np.int64)
    short = np.fromiter((len(c) == 2 * width for c in cells), bool, len(cells))
    for mask, kind in ((short, "<i2"), (~short, "<i4")):
        at = np.flatnonzero(mask)
        if len(at):
            out[at] = np.frombuffer(b"".join([cells[i] for i in at]), kind).reshape(len(at), width)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties to the lower index) and its squared distance, exactly."""
    top = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * top * top * x.shape[1] >= 1 << 63:
        raise OverflowError("distances beyond 64 bits")
    # whole numbers under 2^53 are exact in doubles
    kind = np.float64 if 4 * top * top * x.shape[1] < 1 << 53 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    d = (book * book).sum(1)[None, :] - 2 * (x @ book.T)
    code = d.argmin(1)
    return code, (d[np.arange(len(x)), code] + (x * x).sum(1)).astype(np.int64)


def _batches(batches, books: np.ndarray):
    """Of each block: (batch, rows, position, parts, codes, distances)."""
    width = books.shape[2]
    for batch in batches:
        pos = batch.column("pos").to_numpy(zero_copy_only=False)
        for p in range(books.shape[0]):
            at = np.flatnonzero(pos == p)
            for i in range(0, len(at), BLOCK):
                rows = at[i : i + BLOCK]
                x = unpacked([c.as_py() for c in batch.column("part").take(pa.array(rows))], width)
                yield batch, rows, p, x, *nearest(x, books[p])


def _moved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the distinct parts."""
    parts, entries, width = books.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch, rows, p, x, code, _ in _batches(batches, books):
            n = batch.column("n").to_numpy(zero_copy_only=False)[rows]
            order = np.argsort(code, kind="stable")
            cut = np.flatnonzero(np.diff(code[order], prepend=-1))
            both = np.concatenate([x * n[:, None], n[:, None]], axis=1)[order]
            total[p, code[order][cut]] += np.add.reduceat(both, cut, axis=0)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["cell", "s"])

    sums = np.zeros(parts * entries * (width + 1), np.int64)
    for r in distinct.mapInArrow(run, "cell long, s long").groupBy("cell").agg(F.sum("s").alias("s")).toLocalIterator():  # a codebook's cells
        sums[r["cell"]] = r["s"]
    sums = sums.reshape(parts, entries, width + 1)
    n = sums[:, :, width:]
    return np.where(n > 0, sums[:, :, :width] // np.maximum(n, 1), books)


def _first(kept: DataFrame, scale: int, parts: int, entries: int) -> tuple[int, np.ndarray] | None:
    """(length, codebooks of the smallest ids' vectors); ``entries`` rows at most come to the driver."""
    order = kept.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec")
    got = [r["vec"] for r in order.limit(entries).collect()]
    if not got:
        return None
    dim = len(got[0])
    if any(len(v) != dim for v in got):
        got = [r["vec"] for r in order.where(F.size("vec") == dim).limit(entries).collect()]
    x = integers(np.array(got, np.float64), scale)
    return dim, np.ascontiguousarray(x.reshape(len(x), parts, dim // parts).transpose(1, 0, 2))


def compressed(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """((id, codes, error, label, label_error) of every kept vector, codebooks as (parts, entries, width) integers).

    ``codes`` is an array with an entry's index a part, ``error`` the sum of the parts' squared distances,
    ``label_error`` its sum over the label's vectors.
    """
    spark = df.sparkSession
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    kept = kept.where((F.size("vec") > 0) & (F.size("vec") % parts == 0)).where(whole)
    first = _first(kept, scale, parts, entries)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    if first is None:
        return spark.createDataFrame([], f"id {kinds['id']}, codes array<int>, error long, label {kinds['label']}, label_error long"), np.empty((parts, 0, 0), np.int64)
    dim, books = first
    width = dim // parts

    def cut(batches):
        for b in batches:
            x = integers(np.asarray(b.column("vec").flatten()), scale).reshape(len(b), parts, width)
            cells = [pa.array([packed(row) for row in x[:, p]], pa.binary()) for p in range(parts)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), *cells], names=["id", "label", *[f"p{p}" for p in range(parts)]])

    names = ", ".join(f"p{p} binary" for p in range(parts))
    rows = kept.where(F.size("vec") == dim).mapInArrow(cut, f"id {kinds['id']}, label {kinds['label']}, {names}")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "parts")
    each = rows.select("row", "id", "label", F.posexplode(F.array(*[f"p{p}" for p in range(parts)])).alias("pos", "part"))
    distinct = stored(each.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")), "distinct")
    for _ in range(rounds):
        books = _moved(distinct, books)

    def assign(batches):
        for batch, at, _, _, code, error in _batches(batches, books):
            some = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("pos", "part", "n")], pa.array(code, pa.int32()), pa.array(error)], names=["pos", "part", "n", "code", "error"])

    coded = stored(distinct.select("pos", "part", "n").mapInArrow(assign, "pos int, part binary, n long, code int, error long"), "coded")
    n = rows.count()
    both = rejoined(each, coded, ["pos", "part"], "n", parts * n)
    code = F.array(*[F.max(F.when(F.col("pos") == p, F.col("code"))) for p in range(parts)])
    vectors = both.groupBy("row").agg(F.first("id").alias("id"), F.first("label").alias("label"), code.alias("codes"), F.sum("error").alias("error"))
    vectors = stored(vectors.drop("row"), "codes")
    drop(rows, distinct, coded)
    by_label = stored(vectors.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_errors")
    return rejoined(vectors, by_label, ["label"], "n", n).select("id", "codes", "error", "label", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, decimal, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
