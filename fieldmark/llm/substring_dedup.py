"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words; any
window of ``window`` words holds one whole block of its own document.  So if the window also
starts elsewhere, that block is met there by a rolling window of the block's size:

1. index all blocks and probe them with every rolling window (both as hashes, dealt by hash);
2. extend hits: each window of ``window`` words around a hit is compared, by a 128-bit fingerprint
   of its words, with all others, which tells whether the repeat reaches over the whole window;
   overlapping repeated windows join up to maximal exact repeats, whose words are removed.
   (Of n different windows, n*n / 2^129 pairs share a fingerprint: under 1e-12 for 1e13 windows.)

Texts are dealt once into units (by a hash of id and text); a unit and a hash range exchange only
arrays of hashes and of indices into them, as both sides can derive the order again.  A hash that
is frequent within a unit is settled there and sent on once, so a passage that a third of the
documents share costs each hash range one entry a unit.

Edge cases: null texts count as empty (no words); repeated rows and equal texts are copies of each
other, so all their words go if they have at least ``window`` words; shorter texts stay whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, cells, chunks, dealt
from .words import rolled, starts, windows, words

_PART = "bucket long, unit long, body binary"
_BACK = "unit long, kind int, bucket long, body binary"


class _Unit:
    """The distinct texts of a unit, in a fixed order, as word hashes."""

    def __init__(self, table: pa.Table, wide: bool = True):
        coded = table.column("text").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        text, of = coded.dictionary, coded.indices.to_numpy()
        key = np.empty(len(text), np.int64)
        key[of] = table.column("key").to_numpy()
        order = np.argsort(key)
        if len(np.unique(key)) < len(key):  # different texts with one key
            whole = text.to_pylist()
            order = np.array(sorted(range(len(key)), key=lambda i: (key[i], whole[i])))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = place[of]
        self.copies = np.bincount(self.of, minlength=len(order))
        self.text_once = text.take(pa.array(order))
        hashes, second, counts = [], [], []
        for a, b in chunks(self.text_once):
            w = words(self.text_once.slice(a, b - a), wide=wide)
            hashes.append(w.hash)
            second.append(w.wide)
            counts.append(w.counts())
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.wide = np.concatenate(second) if wide and second else np.empty(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])


def _grouped(h: np.ndarray, wide: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal entries stand together, and where each run of them begins."""
    order = np.argsort(h, kind="stable")
    differ = lambda x: x[1:] != x[:-1]
    new = differ(h[order])
    if wide is not None:
        more = differ(wide[order])
        if (more & ~new).any():  # one hash with two second hashes
            order = np.lexsort((wide, h))
            new = differ(h[order]) | differ(wide[order])
        else:
            new |= more
    return order, np.concatenate([np.ones(min(1, len(h)), bool), new])


class _Sent:
    """Hashes of a unit in order, with those that a unit can settle itself and those it sends out.

    ``index``: entries that stand in the index (None: all do).  Equal hashes with an index entry
    among them are settled here if there are two, and one index entry goes out for all.  With
    ``wide``, entries are equal if both their hashes are.
    """

    def __init__(self, h: np.ndarray, index: np.ndarray | None, weight: np.ndarray | None = None, wide: np.ndarray | None = None):
        self.order, new = _grouped(h, wide)
        self.h = h[self.order]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(h)))
        marked = np.ones(len(h), bool) if index is None else index[self.order]
        if len(h):
            seen = np.cumsum(marked)
            before = np.repeat(seen[begin] - marked[begin], size)
            head = marked & (seen - before == 1)
            has = np.repeat(np.logical_or.reduceat(marked, begin), size)
            many = size if weight is None else np.add.reduceat(weight[self.order], begin)
            self.settled = np.zeros(len(h), bool)
            self.settled[self.order] = has & (np.repeat(many, size) > 1)
            self.out = np.flatnonzero(head | ~has)
        else:
            self.settled, self.out = np.empty(0, bool), np.empty(0, np.int64)

    def parts(self, unit: int, n: int, body) -> pa.Table:
        """A row for each hash range with entries that go out."""
        h = self.h[self.out]
        cut = np.searchsorted(bucket_of(h, n), np.arange(n + 1))
        full = np.flatnonzero(np.diff(cut))
        made = body(h, self.order[self.out])
        return pa.table({
            "bucket": pa.array(full, pa.int64()),
            "unit": pa.array(np.full(len(full), unit, np.int64)),
            "body": pa.array([made[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()),
        })

    def back(self, found: dict[int, np.ndarray], n: int) -> np.ndarray:
        """Entries that are settled or were found elsewhere, in the order of the hashes given."""
        cut = np.searchsorted(bucket_of(self.h[self.out], n), np.arange(n + 1))
        hit = self.settled.copy()
        for b, at in found.items():
            hit[self.order[self.out[cut[b] + at]]] = True
        return hit


def _probe(unit: _Unit, block: int) -> tuple[_Sent, np.ndarray, np.ndarray]:
    h, at, doc = windows(unit.hash, unit.first, block)
    return _Sent(h, (at - unit.first[doc]) % block == 0), at, doc


def _candidates(unit: _Unit, block: int, window: int, found: dict[int, np.ndarray], n: int) -> tuple[_Sent, np.ndarray, np.ndarray]:
    """Whole windows around hits, their first words and their second hashes."""
    sent, at, _ = _probe(unit, block)
    near = np.zeros(len(unit.hash) + 1, np.int64)
    hits = at[sent.back(found, n)]
    np.add.at(near, np.maximum(hits - (window - block), 0), 1)
    np.add.at(near, hits + 1, -1)
    start, doc = starts(unit.first, window)
    pick = np.cumsum(near)[start] > 0
    pick |= unit.copies[doc] > 1
    start, doc = start[pick], doc[pick]
    wide = rolled(unit.wide, window)[start]
    return _Sent(rolled(unit.hash, window)[start], None, unit.copies[doc], wide), start, wide


def _back(table: pa.Table, kind: int) -> dict[int, np.ndarray]:
    kinds, ranges = table.column("kind").to_pylist(), table.column("bucket").to_pylist()
    return {b: body for k, b, body in zip(kinds, ranges, cells(table.column("body"), np.uint32)) if k == kind}


def _match(kind: int, dtype, index: bool):
    """Reduce side: entries of each unit whose hash is indexed and met at least twice."""

    def match(table: pa.Table) -> pa.Table:
        unit, body = table.column("unit").to_pylist(), cells(table.column("body"), dtype)
        size = np.array([len(b) if index else len(b) // 2 for b in body])
        all_h = np.concatenate(body)
        order, new = _grouped(all_h >> 1, None) if index else _grouped(all_h[::2], all_h[1::2])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(order)))
        good = count > 1
        if index:
            good &= np.logical_or.reduceat((all_h[order] & 1).astype(bool), begin)
        hit = np.zeros(len(order), bool)
        hit[order] = np.repeat(good, count)
        cut = np.concatenate([[0], np.cumsum(size)])
        found = [np.flatnonzero(hit[a:b]).astype(np.uint32) for a, b in zip(cut, cut[1:])]
        keep = [i for i, f in enumerate(found) if len(f)]
        return pa.table({
            "unit": pa.array([unit[i] for i in keep], pa.int64()),
            "kind": pa.array([kind] * len(keep), pa.int32()),
            "bucket": pa.array([table.column("bucket")[0].as_py()] * len(keep), pa.int64()),
            "body": pa.array([found[i].tobytes() for i in keep], pa.binary()),
        })

    return match


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """Remove each word in a window of ``window`` words that also starts elsewhere in ``df``.

    Returns the id, ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``
    for each row.  Windows are judged on the input.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    block = (window + 1) // 2
    parts, n = dealt(df, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(parts)).alias("unit"), F.xxhash64(text).alias("key"), F.col(id_col).alias("id"), text.alias("text"))
    none = pa.table({"bucket": pa.array([], pa.int64()), "unit": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})

    def probe(table: pa.Table) -> pa.Table:
        sent, at, doc = _probe(u := _Unit(table, wide=False), block)
        aligned = ((at - u.first[doc]) % block == 0).astype(np.uint32)
        return sent.parts(table.column("unit")[0].as_py(), n, lambda h, i: ((h & np.uint64(0x7FFFFFFF)).astype(np.uint32) << np.uint32(1)) | aligned[i])

    def extend(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return none
        sent, _, wide = _candidates(_Unit(table), block, window, _back(back, 1), n)
        return sent.parts(table.column("unit")[0].as_py(), n, lambda h, i: np.stack([h, wide[i]], axis=1))

    idf = docs.schema["id"]
    out = f"id {idf.dataType.simpleString()}, kept_text string, n_words long, n_removed long"

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        u = _Unit(table) if table.num_rows else None
        kept, removed = [], []
        if u:
            sent, start, _ = _candidates(u, block, window, _back(back, 1), n)
            gone = np.zeros(len(u.hash) + 1, np.int64)
            cut = start[sent.back(_back(back, 2), n)]
            np.add.at(gone, cut, 1)
            np.add.at(gone, cut + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            for i, t in enumerate(u.text_once.to_pylist()):
                flags = gone[u.first[i] : u.first[i + 1]]
                ws = t.encode().split()
                if flags.any():
                    ws = [w for w, g in zip(ws, flags.tolist()) if not g]
                kept.append(b" ".join(ws).decode())
                removed.append(int(flags.sum()))
        of = u.of if u else np.empty(0, np.int64)
        return pa.table({
            "id": table.column("id"),
            "kept_text": pa.array(kept, pa.string()).take(pa.array(of)),
            "n_words": pa.array((u.counts[of] if u else of), pa.int64()),
            "n_removed": pa.array(np.array(removed, np.int64)[of] if u else of, pa.int64()),
        })

    hits = docs.groupBy("unit").applyInArrow(probe, _PART).groupBy("bucket").applyInArrow(_match(1, np.uint32, True), _BACK)
    wide = docs.groupBy("unit").cogroup(hits.groupBy("unit")).applyInArrow(extend, _PART)
    repeats = wide.groupBy("bucket").applyInArrow(_match(2, np.uint64, False), _BACK)
    done = docs.groupBy("unit").cogroup(hits.unionByName(repeats).groupBy("unit")).applyInArrow(finish, out)
    return done.withColumnRenamed("id", id_col)
