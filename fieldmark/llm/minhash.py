"""Near-duplicate documents with HyperMinHash sketches.

A document is the set of its distinct word shingles.  Its sketch deals the shingles' hashes to
registers and keeps, of each register's least hash, the number of leading zeros and ten mantissa
bits (two bytes; 0 when empty).  Bands of compressed registers give candidates, a Jaccard estimate
corrected for chance collisions of registers screens them, and full sets confirm links.

Steps: documents with equal sets (by a 128-bit digest of the sorted set) form a class; classes that agree on a band are grouped.  Groups
of up to ``SMALL`` classes are compared in full, larger ones with two heads; where that leaves a
large group in several components, its classes are grouped anew by the rarest shingles of their sets, one of
which any two that link must share, and pairs across components follow, block by block inside tasks
that return only links that join components, so no group is cut off.  Components come from joins (see ``graph``); nothing is gathered on the driver.

Number of bands: the most rows a band may have so that a pair right at the threshold is missed
with a probability under 2e-5.

Edge cases: null or wordless texts have an empty set and link with nothing; texts with fewer words
than a shingle are one shingle; repeated rows are linked with each other; null ids count as larger
than any id, and a component of them alone has the id null and is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, chunks, drop, small, stored
from .graph import components
from .words import mix, sequence_hash, windows, words

MANTISSA = 10
REGISTERS = 160
SMALL = 8
#: Rows and shingles (on average) of a block of a group.
BLOCK, BLOCK_ITEMS = 512, 1 << 21
#: Standard errors below the threshold at which an estimate rules a pair out.
SLACK = 4.5
#: Bits of the map that tells which texts' sets are needed (2 MB); beyond it merely lets more texts pass.
MAP_BITS = 1 << 24


def plan(similarity: float) -> tuple[int, int]:
    """(rows a band, bands) within REGISTERS."""
    for rows in range(12, 1, -1):
        bands = REGISTERS // rows
        if (1 - similarity**rows) ** bands < 2e-5:
            return rows, bands
    return 1, REGISTERS


def shingle_sets(text: pa.Array, size: int):
    """For each text, its sorted distinct shingle hashes (A-Z folded)."""
    w = words(text, lower=True)
    h, _, doc = windows(w.hash, w.first, size)
    cut = np.searchsorted(doc, np.arange(len(text) + 1))
    short = sequence_hash(w.hash, w.first, size)
    counts = w.counts()
    for i in range(len(text)):
        if cut[i + 1] > cut[i]:
            yield np.unique(h[cut[i] : cut[i + 1]])
        else:
            yield short[i : i + 1] if counts[i] else h[:0]


def sketch(shingles: np.ndarray, registers: int) -> np.ndarray:
    """Register values: leading zeros of the least hash and its next bits, plus 1; 0 when empty."""
    out = np.zeros(registers, np.uint16)
    if len(shingles):
        with np.errstate(over="ignore"):
            value = mix(shingles + np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
        slot = (((shingles >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((value, slot))
        slot, value = slot[order], value[order]
        head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        least = value[head]
        zeros = 63 - np.frexp(least.astype(np.float64))[1] + 1
        zeros += ((least << zeros.astype(np.uint64)) >> np.uint64(63)) == 0  # rounding to a power of two
        mantissa = (least << zeros.astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
        out[slot[head]] = np.minimum(zeros, 62) * (1 << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of sketch rows, and how many registers they rest on.

    Registers of unrelated sets agree by chance where both minima fall into one cell.  With k and m
    elements a register the minima are about exponential, a cell at x is x * 2**-MANTISSA / (2 ln 2)
    wide on average, and the integral over x gives 0.7213 * 2**-MANTISSA * k * m / (k + m)**2.
    """
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    chance = 0.7213 * 2.0**-MANTISSA * na * nb / (na + nb) ** 2.0
    return np.clip((same / np.maximum(used, 1) - chance) / (1 - chance), 0, 1), used


def _signatures(docs: DataFrame, size: int, registers: int) -> DataFrame:
    """id, key (of the text), set (a digest), n (its size), sketch."""
    idf = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for s, e in chunks(text):
                digest, n, sk = [], [], []
                for x in shingle_sets(text.slice(s, e - s), size):
                    digest.append(hashlib.blake2b(x, digest_size=16).digest())
                    n.append(len(x))
                    sk.append(sketch(x, registers).tobytes() if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(s, e - s), batch.column("key").slice(s, e - s), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(sk, pa.binary())],
                    names=["id", "key", "set", "n", "sketch"],
                )

    return docs.mapInArrow(run, f"id {idf}, key long, set binary, n long, sketch binary")


def _bands(classes: DataFrame, rows: int, bands: int) -> DataFrame:
    """(band, c, n): a hash of each band that isn't empty."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.stack(cells(batch.column("sketch"), np.uint16))[:, : rows * bands].reshape(-1, bands, rows).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for r in range(rows):
                    h = mix(h ^ (regs[:, :, r] + np.uint64(r << 20)))
            doc, band = np.nonzero(regs.any(axis=2))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(h[doc, band].astype(np.int64)), batch.column("c").take(take), batch.column("n").take(take)], names=["band", "c", "n"])

    return classes.select("c", "n", "sketch").mapInArrow(run, "band long, c long, n long")


def _screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate doesn't rule them out, with the estimate."""
    side = lambda x: classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    t = percent / 100

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack(cells(batch.column(x), np.uint16)) for x in ("sa", "sb"))
                est, used = estimate(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                ok = pa.array(est >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1)))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(est).filter(ok)], names=["a", "b", "est"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, est double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(cells(batch.column("xa"), np.uint64), cells(batch.column("xb"), np.uint64)):
                both = np.concatenate([x, y])
                both.sort()
                inner = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inner >= percent * (len(both) - inner))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    side = lambda x: sets.select(F.col("c").alias(x), F.col("items").alias(f"x{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """(c, items) of the classes in ``need(c)``, from the text of one document each.

    A map of ``MAP_BITS`` bits over text keys leaves most texts that nobody needs out of the shuffle.
    """
    reps = classes.join(need, "c").select("c", F.col("rep.id").alias("rid"), F.col("rep.key").alias("rkey"))
    bit = F.pmod("rkey", F.lit(MAP_BITS)) + 1
    maps = reps.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    packed = np.zeros(MAP_BITS // 8, np.uint8)
    for m in maps:  # bucket k has 4 KB, the bits from (k - 1) * 2**15 on
        packed[(m["at"] - 1) << 12 : m["at"] << 12] = np.frombuffer(m["bits"], np.uint8)

    def wanted(batches):
        marks = np.unpackbits(packed, bitorder="little").view(bool)
        for batch in batches:
            yield batch.filter(pa.array(marks[batch.column("key").to_numpy() % MAP_BITS]))

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            for s, e in chunks(text):
                items = [x.tobytes() for x in shingle_sets(text.slice(s, e - s), size)]
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(s, e - s), pa.array(items, pa.binary())], names=["c", "items"])

    same = (F.col("key") == F.col("rkey")) & F.col("id").eqNullSafe(F.col("rid"))
    few = docs.mapInArrow(wanted, docs.schema)
    return few.join(reps, same).select("c", "text").mapInArrow(run, "c long, items binary").dropDuplicates(["c"])


def _overlap(na: str, nb: str, percent: int) -> str:
    """Least intersection of sets of two sizes that link, as SQL."""
    return f"ceil({percent} * ({na} + {nb}) / {100 + percent})"


def _by_rarest(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(band, c, n, nth, comp, size, load): classes (c, n, comp) grouped anew by shingles, for groups that hold several components.

    In one order of all shingles, here the rarest first, two sets with 100 * intersection >= percent * union
    share one of the first n - ceil(n * percent / 100) + 1 of either.  Where the first that they share is the ``nth`` of a set, only it and what
    follows can be in both, which must suffice with the smallest set of the group that is large enough.
    """

    def run(batches):
        for batch in batches:
            items = cells(batch.column("items"), np.uint64)
            size = [len(x) for x in items]
            one = np.concatenate(items).view(np.int64) if items else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(one)], names=["c", "shingle"])

    every = sets.mapInArrow(run, "c long, shingle long")
    often = stored(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")), "shingles")
    first = Window.partitionBy("c").orderBy("often", "shingle")
    ranked = every.join(often, "shingle").withColumn("nth", F.row_number().over(first)).join(rest.select("c", "n", "comp").distinct(), "c")
    head = ranked.where(F.expr(f"nth <= n - ceil(n * {percent} / 100) + 1") & (F.col("often") > 1)).select(F.col("shingle").alias("band"), "c", "n", "nth", "comp")
    head = stored(head, "rarest")
    many = [F.min("comp").alias("lo"), F.max("comp").alias("hi")]
    least = stored(head.groupBy("band").agg(*many, F.min("n").alias("least")).where("lo <> hi").select("band", "least"), "least")
    able = F.expr(f"1 + n - nth >= {_overlap('n', f'greatest(least, ceil(n * {percent} / 100))', percent)}")
    able = stored(head.join(least, "band").where(able).drop("least"), "able")
    size = able.groupBy("band").agg(*many, F.count(F.lit(1)).alias("size"), F.sum("n").alias("load")).where("lo <> hi")
    size = stored(size.select("band", "size", "load"), "sizes")
    out = stored(able.join(size, "band"), "rest")
    drop(often, head, least, able, size)
    return out


def _dealt(rest: DataFrame) -> DataFrame:
    """Rows of groups (band, c, ..., size, load) once for every pair of blocks that they meet in, with their own block ``i``."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("load") / BLOCK_ITEMS)).cast("int")
    one = rest.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    at = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("i")).alias("lo"), F.greatest(j, F.col("i")).alias("hi")))
    return one.withColumn("at", F.explode(at)).select("band", "at.*", "i", "c", "n", "nth", "comp")


def _partners(table: pa.Table, percent: int):
    """For each row of a pair of blocks the later rows that may link with it, across components and blocks, that no bound rules out."""
    t = percent / 100
    n, nth, comp, i = (table.column(x).to_numpy() for x in ("n", "nth", "comp", "i"))
    regs = np.stack(cells(table.column("sketch"), np.uint16))
    across = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
    left = 1 + n - nth
    for x in range(len(n) - 1):
        ys = slice(x + 1, None)
        # enough elements, and enough of them from the shared one on
        ok = (comp[ys] != comp[x]) & (100 * np.minimum(n[x], n[ys]) >= percent * np.maximum(n[x], n[ys]))
        ok &= (100 + percent) * np.minimum(left[x], left[ys]) >= percent * (n[x] + n[ys])
        if across:
            ok &= i[ys] != i[x]
        at = x + 1 + np.flatnonzero(ok)
        if len(at):
            est, used = estimate(regs[x : x + 1], regs[at], np.full(len(at), n[x]), n[at])
            at = at[est >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(used, 1))]
        if len(at):
            yield x, at


def _joining(rest: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that a link joins, within groups, from rows of :func:`_by_rarest`.

    A group is cut into blocks by rows and by shingles, and every pair of blocks is a task's work.  It is done twice: first on
    sketches, to find the classes that some bound leaves a partner; then on the full sets of these, to return links
    that join components which the task had apart.
    """
    with_sketch = lambda df: df.join(classes.select("c", "sketch"), "c")

    def open_(table: pa.Table) -> pa.Table:
        some = np.unique([k for x, at in _partners(table, percent) for k in (x, *at.tolist())]).astype(np.int64)
        return table.select(["band", "lo", "hi", "i", "c", "n", "nth", "comp"]).take(pa.array(some))

    kinds = "band long, lo int, hi int, i int, c long, n long, nth int, comp long"
    left = stored(with_sketch(_dealt(rest)).groupBy("band", "lo", "hi").applyInArrow(open_, kinds), "partners")

    def run(table: pa.Table) -> pa.Table:
        comp, items = table.column("comp").to_numpy(), cells(table.column("items"), np.uint64)
        root = {int(x): int(x) for x in comp}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for x, at in _partners(table, percent):
            for y in at.tolist():
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p != q:
                    few, many = sorted((items[x], items[y]), key=len)
                    place = np.minimum(np.searchsorted(many, few), len(many) - 1)
                    inner = int((many[place] == few).sum())
                    if 100 * inner >= percent * (len(few) + len(many) - inner):
                        root[p] = q
                        links.append((int(comp[x]), int(comp[y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    body = with_sketch(left).join(sets, "c")
    out = stored(body.groupBy("band", "lo", "hi").applyInArrow(run, "a long, b long"), "links")
    drop(left)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` (least id reachable over links) and ``kept``,
    with ``text_key`` (xxhash64 of the text) and ``first_key``, that of the component's first text.

    Linked are rows with 100 * intersection >= percent * union of their sets of ``size``-word shingles.
    """
    rows, bands = plan(percent / 100)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    signed = stored(_signatures(docs, size, rows * bands), "signatures")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("rep")
    # numbers of classes are unique, as each is settled when its part of the table is written
    classes = signed.where("n > 0").groupBy("set").agg(rep, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    group = _bands(classes, rows, bands).groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    group = stored(group, "groups")
    member = _bands(classes, rows, bands).join(small(group), "band")
    member = stored(member, "members")
    drop(group)
    # the original of a group of copies shares bands with more of them than they do among each other
    known = member.groupBy("c").agg(F.sum("size").alias("known"))
    who = F.struct("c", "n")
    head = member.where(f"size > {SMALL}").join(known, "c").groupBy("band").agg(F.array(F.max_by(who, F.struct("known", "c")), F.min_by(who, "c")).alias("heads"))
    head = stored(head, "heads")
    near = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    star = member.where(f"size > {SMALL}").join(head, "band").select("c", "n", F.explode(F.array_distinct("heads")).alias("head")).where("c <> head.c")
    ends = F.when(F.col("c") < F.col("head.c"), F.struct(who.alias("a"), F.col("head").alias("b"))).otherwise(F.struct(F.col("head").alias("a"), who.alias("b")))
    star = star.select(ends.alias("e")).select(F.col("e.b.c").alias("b"), F.col("e.b.n").alias("nb"), F.col("e.a.c").alias("a"), F.col("e.a.n").alias("na"))
    few = member.where(f"size <= {SMALL}").groupBy("band").agg(F.collect_list(who).alias("who"))  # SMALL at most
    few = few.select(F.explode("who").alias("a"), "who").select("a", F.explode("who").alias("b")).where("a.c < b.c")
    few = few.select(F.col("b.c").alias("b"), F.col("b.n").alias("nb"), F.col("a.c").alias("a"), F.col("a.n").alias("na"))
    pairs = few.unionByName(star).where(near).select("a", "b").distinct()
    pairs = stored(_screened(pairs, classes, percent), "candidates")
    need = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    sets = stored(_sets(docs, classes, need, size), "sets")
    links = stored(_confirmed(pairs, sets, percent), "links")
    drop(head, pairs, sets)
    comp = stored(components(links), "components")
    drop(links)

    # large groups that still lie in several components
    big = member.where(f"size > {SMALL}").join(comp, F.col("c") == F.col("node"), "left").select("band", "c", "n", F.coalesce("comp", "c").alias("comp"))
    split = big.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    split = stored(split, "split")
    rest = stored(big.join(split.select("band", "size"), "band"), "rest")
    drop(member, split)
    if not rest.isEmpty():
        sets = stored(_sets(docs, classes, rest.select("c").distinct(), size), "sets")
        anew = _by_rarest(rest, sets, percent)
        more = _joining(anew, classes, sets, percent)
        drop(sets, anew)
        if not more.isEmpty():
            joined = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
            every = comp.unionByName(classes.select(F.col("c").alias("node"), F.col("c").alias("comp")).join(comp.select("node"), "node", "left_anti"))
            before, comp = comp, stored(every.join(joined, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")
            drop(before)
        drop(more)
    drop(rest)

    # the least row of each component; a component of many classes is one row here and an exchange that can be split
    first = classes.join(comp, F.col("c") == F.col("node")).groupBy("comp").agg(F.min("rep").alias("first"))
    first = stored(first, "firsts")
    named = classes.join(comp.join(first, "comp").select("node", "first"), F.col("c") == F.col("node"), "left")
    named = named.select("set", F.coalesce("first", "rep").alias("first")).select("set", F.col("first.id").alias("component_id"), F.col("first.key").alias("first_key"))
    found = signed.where("n > 0").select("id", "n", "set", "key").join(named, "set").select("id", "n", "component_id", "key", "first_key")
    none = signed.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "key", F.col("key").alias("first_key"))
    out = found.unionByName(none)
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("key").alias("text_key"), "first_key")
    out = stored(out, "near_duplicates")
    drop(signed, classes, comp, first)
    return out
