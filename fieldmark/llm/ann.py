"""Nearest neighbours by cosine with score-aware (anisotropic) quantisation.

On unit vectors the largest cosine is the largest inner product, so errors of a code that lie
along the vector matter more than those across it.

Index: vectors go to the nearest of some coarse centres, and within a cell to blocks of bounded
size.  A block finds finer centres among its own vectors and codes each vector's residual from
the nearest of them: its length, and its direction, cut into pairs of dimensions coded by one of 16
centres (four bits), fitted to ``|residual error|^2 + (ETA - 1) * |error along the vector|^2``.  Lengths
apart, so near copies are told from each other as well as strangers are.

Search: a query makes a table of inner products with all centres of codes and scans the packed
codes (two to a byte, so tables of 256 entries).  It scans the cells of its ``FIRST`` nearest centres, and
then all cells that could hold a better one than the k-th best so far: in which ``MISS`` members or more are
expected above it, by the normal curve around the centre's score.  All vectors whose estimate and
``SURE`` standard errors of it reach the k-th best estimate (so all ties) are scored exactly, in double
precision on the original vectors; there is no cap on them.

Equal vectors are one class: they share a code, and only the ids that can be among a query's
nearest (its k + 1 least) go on, picked before the shuffle.  Centres are fitted on a sample of at
most ``TRAIN`` vectors (least hashes), everything is indexed; at most ``CELLS`` cells.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows without id; of different lengths, only the most frequent takes part; repeated rows with one
id count once; an id with several vectors is several candidates, but never its own neighbour.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, small, stored

TRAIN = 20_000
ETA = 3.0
CENTRES, PAIR = 16, 2
FITS = 12
#: Vectors in a cell by design, most cells (their centres go to every task), vectors in a block, queries in a block.
CELL, CELLS, CODE_BLOCK, QUERY_BLOCK = 2_048, 1_024, 32_768, 4_096
FIRST, SURE, MISS = 2, 3.0, 0.005


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; powers of two first take out what would overflow."""
    v = _scaled(v)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _scaled(v: np.ndarray) -> np.ndarray:
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _sides(x: np.ndarray) -> np.ndarray:
    """Vectors (n, d) as (n, d / 2, 2); an odd last dimension is padded."""
    if x.shape[1] % PAIR:
        x = np.concatenate([x, np.zeros((len(x), 1), x.dtype)], axis=1)
    return x.reshape(len(x), -1, PAIR)


def centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means from ``n`` spread rows; at most as many as there are different rows."""
    c = np.unique(x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        at = closest(x, c)
        k = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = total[k > 0] / k[k > 0, None]
    return c


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def encode(way: np.ndarray, unit: np.ndarray, books: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Codes (n, m) of directions ``way``: coordinate descent on the anisotropic loss from the nearest centres.

    With error e = way - code, the loss is |e|^2 + (ETA - 1) * <e, unit>^2, so a change in one pair of
    dimensions is weighed against the error of all others along the vector.
    """
    x, u = _sides(way), _sides(unit)
    n, m, _ = x.shape
    dist = (x**2).sum(2)[:, :, None] - 2 * np.einsum("nmp,mkp->nmk", x, books) + (books**2).sum(2)[None]
    along = (x * u).sum(2)[:, :, None] - np.einsum("nmp,mkp->nmk", u, books)  # each pair's share of <e, unit>
    code = dist.argmin(2)
    rows = np.arange(n)
    total = along[rows[:, None], np.arange(m)[None], code].sum(1)
    for _ in range(rounds):
        for j in range(m):
            others = total - along[rows, j, code[:, j]]
            loss = dist[:, j] + (ETA - 1) * (others[:, None] + along[:, j]) ** 2
            code[:, j] = loss.argmin(1)
            total = others + along[rows, j, code[:, j]]
    return code.astype(np.uint8)


def decode(code: np.ndarray, books: np.ndarray, d: int) -> np.ndarray:
    return books[np.arange(len(books))[None], code].reshape(len(code), -1)[:, :d]


def fit(way: np.ndarray, unit: np.ndarray, rounds: int = FITS) -> np.ndarray:
    """Centres (m, 16, 2), from k-means started on spread points and then on the anisotropic loss."""
    x = _sides(way)
    n, m, _ = x.shape
    books = np.empty((m, CENTRES, PAIR))
    for j in range(m):
        order = np.lexsort((x[:, j, 1], x[:, j, 0]))
        books[j] = x[order[np.linspace(0, n - 1, CENTRES).astype(int)], j] + 1e-6 * np.arange(CENTRES)[:, None]
    for step in range(rounds):
        if step < rounds // 2:
            code = (-2 * np.einsum("nmp,mkp->nmk", x, books) + (books**2).sum(2)[None]).argmin(2)
        else:
            code = encode(way, unit, books, 1).astype(np.int64)
        for j in range(m):
            k = np.bincount(code[:, j], minlength=CENTRES)
            used = k > 0
            for p in range(PAIR):
                s = np.bincount(code[:, j], weights=x[:, j, p], minlength=CENTRES)
                books[j, used, p] = s[used] / k[used]
    return books


def split(unit: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre, length of the residual and its direction (0 for vectors on their centre)."""
    at = closest(unit, c)
    r = unit - c[at]
    length = np.sqrt((r * r).sum(1))
    return at, length, r / np.where(length > 0, length, 1)[:, None]


def pack(code: np.ndarray) -> np.ndarray:
    if code.shape[1] % 2:
        code = np.concatenate([code, np.zeros((len(code), 1), np.uint8)], axis=1)
    return code[:, ::2] | (code[:, 1::2] << 4)


def tables(query: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of a query's pairs of sub-vectors with all 256 pairs of centres: (m / 2, 256)."""
    t = np.einsum("mp,mkp->mk", _sides(query[None])[0], books)
    if len(t) % 2:
        t = np.concatenate([t, np.zeros((1, CENTRES))])
    return (t[1::2, :, None] + t[::2, None, :]).reshape(-1, CENTRES * CENTRES).astype(np.float32)


def _vectors(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if isinstance(column, pa.Array) else np.stack(column.to_numpy())


_INDEX = "cell int, block int, c binary, codes binary, at binary, length binary, fine binary, error double"
_FOUND = "q long, c long, s double, e double"


def _indexed(classes: DataFrame, coarse: np.ndarray, books: np.ndarray, blocks: DataFrame) -> DataFrame:
    """A row for each block: class ids, packed codes, fine centre and residual length of each vector, fine centres, mean error of directions."""
    d = coarse.shape[1]

    def build(table: pa.Table) -> pa.Table:
        unit = _unit(_vectors(table.column("v")))
        fine = centres(unit, int(np.ceil(np.sqrt(len(unit)))), 4)
        at, length, way = split(unit, fine)
        code = encode(way, unit, books)
        error = np.sqrt(((way - decode(code, books, d)) ** 2).sum(1).mean())
        cell = lambda x, t: pa.array([np.ascontiguousarray(x, t).tobytes()], pa.binary())
        return pa.table({
            "cell": table.column("cell")[:1], "block": table.column("block")[:1], "c": cell(table.column("c").to_numpy(), np.int64), "codes": cell(pack(code).T, np.uint8),
            "at": cell(at, np.uint16), "length": cell(length, np.float32), "fine": cell(fine, np.float32), "error": pa.array([error]),
        })

    dealt = classes.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"), "c", "v")
    return dealt.groupBy("cell", "block").applyInArrow(build, _INDEX)


def _scanned(probes: DataFrame, asked: DataFrame, index: DataFrame, blocks: DataFrame, books: np.ndarray, d: int, k: int) -> DataFrame:
    """(q, c, s, e): estimates and their standard errors, from probes (q, cell, least) of query ids, cells and the score to reach."""
    parts = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = small(stored(parts, "parts"))
    ask = probes.join(blocks, "cell").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))
    ask = ask.join(asked, "q").select("q", "least", "v", "cell", "part", each("blocks").alias("block"))
    held = index.join(parts, "cell").withColumn("part", each("parts"))

    def scan(ask: pa.Table, held: pa.Table) -> pa.Table:
        qs, cs, ss, es = [], [], [], []
        if ask.num_rows and held.num_rows:
            get = lambda name, t: np.frombuffer(held.column(name)[0].as_buffer(), t)
            c, at, length, fine = get("c", np.int64), get("at", np.uint16), get("length", np.float32), get("fine", np.float32).reshape(-1, d)
            code = get("codes", np.uint8).reshape(-1, len(c)).astype(np.intp)
            e = length.astype(float) * held.column("error")[0].as_py() / np.sqrt(d)
            query = _unit(_vectors(ask.column("v")))
            base = query @ fine.T
            for q, least, v, b in zip(ask.column("q").to_pylist(), ask.column("least").to_pylist(), query, base):
                t = tables(v, books)
                s = t[0].take(code[0])
                for j in range(1, len(t)):
                    s += t[j].take(code[j])
                s = b[at] + length * s.astype(float)
                cut = max(least, np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf)
                best = np.flatnonzero(s + SURE * e >= cut)
                qs.append(np.full(len(best), q))
                cs.append(c[best])
                ss.append(s[best])
                es.append(e[best])
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
        return pa.table({"q": cat(qs, pa.int64()), "c": cat(cs, pa.int64()), "s": cat(ss, pa.float64()), "e": cat(es, pa.float64())})

    keys = ("cell", "block", "part")
    return ask.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(scan, _FOUND)


def nearest(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each row whose id is divisible by ``every``."""
    value = F.transform(vector_col, lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), value.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    every_row = rows = stored(rows, "vectors")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return df.sparkSession.createDataFrame([], out)
    d = dims["d"]
    rows = rows.where(F.size("v") == d)
    first = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("c", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    asked = stored(rows.where(F.col("id") % every == 0).distinct().select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "v"), "queries")
    # own classes of an id that may stand before the k nearest, its other vectors included
    own = rows.distinct().groupBy("id").count().where(F.col("id") % every == 0).agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    want = k + own
    drop(every_row)

    whole = classes.count()
    sample = _unit(np.stack(classes.orderBy(F.xxhash64("v")).limit(TRAIN).select("v").toPandas()["v"].to_numpy()))
    coarse = centres(sample, min(CELLS, -(-whole // CELL)))
    _, _, way = split(sample, centres(sample, int(np.ceil(np.sqrt(len(sample)))), 4))
    books = fit(way, sample)

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_vectors(batch.column("v")))
                at = closest(unit, coarse)
                r = ((unit - coarse[at]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("v"), pa.array(at, pa.int32()), pa.array(r)], names=["c", "v", "cell", "r"])

    members = stored(classes.select("c", "v").mapInArrow(placed, "c long, v array<double>, cell int, r double"), "members")
    blocks = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CODE_BLOCK).cast("int").alias("blocks"), F.sqrt(F.avg("r") / d).alias("spread"), F.count(F.lit(1)).alias("size"))
    blocks = stored(blocks, "blocks")
    spread = np.full(len(coarse), -np.inf)
    for b in blocks.collect():  # CELLS rows at most
        spread[b["cell"]] = b["spread"] * NormalDist().inv_cdf(1 - MISS / max(b["size"], 1))
    blocks = F.broadcast(blocks.select("cell", "blocks"))
    index = stored(_indexed(members, coarse, books, blocks), "index")
    drop(members)

    def probing(pick):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    s = _unit(_vectors(batch.column("v"))) @ coarse.T
                    near = np.argsort(-np.where(np.isfinite(spread), s, -np.inf), axis=1)[:, :FIRST]
                    first = np.zeros(s.shape, bool)
                    np.put_along_axis(first, near, True, axis=1)
                    first &= np.isfinite(spread)
                    least = batch.column("least").to_numpy()
                    row, cell = np.nonzero(pick(first, s, least))
                    yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(least[row])], names=["q", "cell", "least"])

        return run

    kind = "q long, cell int, least double"
    nothing = F.lit(float("-inf")).alias("least")
    probes = asked.select("q", "v", nothing).mapInArrow(probing(lambda first, s, least: first), kind)
    one = stored(_scanned(stored(probes, "probes"), asked.select("q", "v"), index, blocks, books, d, want), "found")
    best = Window.partitionBy("q").orderBy(F.desc("s"))
    reached = one.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= want).groupBy("q").agg(F.min("s").alias("s"), F.count(F.lit(1)).alias("n"))
    reached = reached.select("q", F.when(F.col("n") == want, F.col("s")).otherwise(F.lit(float("-inf"))).alias("least"))
    wider = asked.select("q", "v").join(reached, "q", "left").select("q", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    probes = wider.mapInArrow(probing(lambda first, s, least: ~first & np.isfinite(spread) & (s + np.where(np.isfinite(spread), spread, 0) >= least[:, None])), kind)
    two = stored(_scanned(stored(probes, "probes"), asked.select("q", "v"), index, blocks, books, d, want), "found")
    found = one.unionByName(two).withColumn("nth", F.row_number().over(best))
    found = found.withColumn("least", F.min(F.when(F.col("nth") == want, F.col("s"))).over(Window.partitionBy("q")))
    found = found.where(F.col("least").isNull() | (F.col("s") + SURE * F.col("e") >= F.col("least"))).select("q", "c")

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_scaled(_vectors(batch.column(x))) for x in ("qv", "v"))
                s = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), batch.column("ids"), pa.array(s)], names=["query_id", "q", "ids", "score"])

    pairs = found.join(classes, "c").join(asked.select("q", "query_id", F.col("v").alias("qv")), "q")
    scored = pairs.select("query_id", "q", "qv", "v", "ids").mapInArrow(exact, "query_id long, q long, ids array<long>, score double")
    scored = scored.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = stored(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    drop(one, two, index, classes, asked)
    return ranked
