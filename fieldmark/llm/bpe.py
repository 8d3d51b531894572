"""Byte-level BPE encoding and decoding by merge replay over the corpus' distinct pieces.

1. Rows are dealt to units of bounded size by a hash of their kept columns and text, in compressed parts, so that copies of a
   text go to many units.
2. A unit cuts its texts by the tokenizer's pattern and sends its distinct pieces to hash ranges.
3. A range, with each of its distinct pieces once whatever the number of units that hold it, replays
   the merges block by block: an inverted index from token pair to positions in all the block's
   pieces, and a heap of the pairs by rank.  Each merge is applied once, in rank order, at all its positions,
   and only the pairs with the two neighbours of a position are updated.  A range's pieces return to each unit as ids.
4. A unit cuts its texts again and looks the pieces up.

Edge cases: null texts count as empty (no ids); long pieces and texts are encoded whole; repeated
rows are rows of their own; other columns than those kept don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells, chunks, dealt

#: Text in a part of a unit, text whose pieces fall into a range, bytes of pieces that are replayed together.
PACK_BYTES, PIECE_BYTES, BLOCK_BYTES = 8 << 20, 16 << 20, 1 << 20
#: Pieces whose ids are put together at once (a longer text stands alone).
AT_ONCE = 1 << 18


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the token's bytes and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def merge_table(path: str) -> dict[int, int]:
    """left id << 32 | right id -> the id of the token with the bytes of both."""
    ranks = load_ranks(path)
    get = ranks.get
    return {
        a << 32 | b: r
        for token, r in ranks.items()
        for i in range(1, len(token))
        if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None
    }


def replay(pieces: list[bytes], ranks: dict[bytes, int], merges: dict[int, int]) -> list[tuple[int, ...]]:
    """Token ids of each piece.

    Positions of all pieces stand in one array of tokens, linked to their neighbours; ``pairs`` maps
    a rank (a merge may be reached by several pairs) to the positions of pairs that merge to it.
    Within a piece the lowest rank goes first and, at one rank, the leftmost position.  A merge can
    make a pair of a lower rank than its own (in vocabularies cut from others); the piece's further
    positions at the present rank then wait until that pair is done.
    """
    out: list[tuple[int, ...]] = [() if (r := ranks.get(p)) is None else (r,) for p in pieces]
    byte = [ranks[bytes([b])] for b in range(256)]
    open_ = [k for k, p in enumerate(pieces) if p and not out[k]]
    size = [len(pieces[k]) for k in open_]
    token = list(map(byte.__getitem__, b"".join([pieces[k] for k in open_])))
    left, right = list(range(-1, len(token) - 1)), list(range(1, len(token) + 1))
    owner: list[int] = []
    start = []
    for k, n in zip(open_, size):
        start.append(len(owner))
        owner += [k] * n
        left[start[-1]] = right[len(owner) - 1] = -1
    get = merges.get
    pairs: dict[int, list[int]] = defaultdict(list)
    for i, (a, b, j) in enumerate(zip(token, token[1:], right)):
        if j >= 0 and (r := get(a << 32 | b)) is not None:
            pairs[r].append(i)
    heap = list(pairs)
    heapq.heapify(heap)
    push = heapq.heappush
    while heap:
        rank = heapq.heappop(heap)
        waits: set[int] = set()
        later: list[int] = []
        for i in sorted(pairs.pop(rank, ())):
            j = right[i]
            if j < 0 or get(token[i] << 32 | token[j]) != rank:
                continue  # a neighbour has changed it since
            if waits and owner[i] in waits:
                later.append(i)
                continue
            token[i] = rank
            k, right[j] = right[j], -1
            right[i] = k
            if k >= 0:
                left[k] = i
                if (r := get(rank << 32 | token[k])) is not None:
                    if r not in pairs:
                        push(heap, r)
                    pairs[r].append(i)
                    if r <= rank:
                        waits.add(owner[i])
            if (h := left[i]) >= 0 and (r := get(token[h] << 32 | rank)) is not None:
                if r not in pairs:
                    push(heap, r)
                pairs[r].append(h)
                if r <= rank:
                    waits.add(owner[i])
        if later:
            if rank not in pairs:
                push(heap, rank)
            pairs[rank].extend(later)
    for k, a in zip(open_, start):
        ids = []
        while a >= 0:
            ids.append(token[a])
            a = right[a]
        out[k] = tuple(ids)
    return out


class Vocabulary:
    """Ranks, merges and pattern of a tokenizer."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.merges, self.find = load_ranks(path), merge_table(path), regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.kind = np.uint16 if len(self.bytes_of) <= 1 << 16 else np.int32  # of an id as it is sent

    def replayed(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each piece, in blocks."""
        out: list[tuple[int, ...]] = []
        block: list[bytes] = []
        size = 0
        for p in pieces:
            block.append(p)
            size += len(p)
            if size >= BLOCK_BYTES:
                out += replay(block, self.ranks, self.merges)
                block, size = [], 0
        return out + replay(block, self.ranks, self.merges) if block else out

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, end to end, and how many each has."""
        return self.data[_runs(self.at[ids], self.size[ids])], self.size[ids]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, end to end."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(body) -> pa.Table:
    with pa.ipc.open_stream(body) as rows:
        return rows.read_all()


def _ranged(every: Iterable[str], n: int) -> list[list[str]]:
    """Distinct pieces by hash range, in order."""
    out: list[list[str]] = [[] for _ in range(n)]
    crc = zlib.crc32
    for p in sorted(every):
        out[crc(p.encode()) % n].append(p)
    return out


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Per row: the columns ``keep`` (default: the id), ``ids array<int>``, ``n_tokens`` and ``decoded``
    (the bytes the ids stand for).

    With ``digests``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` stand in for ``ids`` and ``decoded``.  The ranks are read from ``ranks_path``,
    a file that every worker has, once a worker.
    """
    keep = tuple(keep or (id_col,))
    body = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded binary"
    names = [*keep, *[x.split()[0] for x in body.split(", ")]]
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts, n = dealt(df, text_col, PIECE_BYTES)
    parts = -(-parts // 2)  # larger units share more pieces, and a unit holds little else
    docs = df.select(*keep, text.alias("__text"), F.pmod(F.xxhash64(*keep, text), F.lit(parts)).alias("__unit"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[: len(keep)]]
    text_at = len(keep)

    def pack(batches):
        for rows in batches:
            of = rows.column(text_at + 1).to_numpy()
            order = np.argsort(of, kind="stable")
            of = of[order]
            rows = rows.take(pa.array(order)).select(range(text_at + 1))
            unit, body = [], []
            for start in np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]])).tolist():
                own = rows.slice(start, int(np.searchsorted(of, of[start], "right")) - start)
                for a, b in chunks(own.column(text_at), PACK_BYTES):
                    unit.append(int(of[start]))
                    body.append(_packed(own.slice(a, b - a)))
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(body, pa.binary())], names=["unit", "body"])

    units = docs.mapInArrow(pack, "unit long, body binary")

    def opened(table: pa.Table) -> pa.Table:
        return pa.concat_tables([_unpacked(x.as_buffer()) for x in table.column("body")])

    def send(table: pa.Table) -> pa.Table:
        find = vocabulary(ranks_path, pattern).find
        every: set[str] = set()
        for t in opened(table).column(text_at):
            every.update(find(t.as_py()))
        sent = [[p.encode() for p in ps] for ps in _ranged(every, n)]
        full = [k for k, ps in enumerate(sent) if ps]
        return pa.table({
            "unit": pa.array([table.column("unit")[0].as_py()] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64()),
            "pieces": pa.array([zlib.compress(b"".join(sent[k]), 1) for k in full], pa.binary()),
            "lengths": pa.array([np.array([len(p) for p in sent[k]], np.int32).tobytes() for k in full], pa.binary()),
        })

    def encode(table: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        of = []
        for whole, size in zip(cells(table.column("pieces"), np.uint8), cells(table.column("lengths"), np.int32)):
            whole, cut = zlib.decompress(whole), np.concatenate([[0], np.cumsum(size)]).tolist()
            of.append([place.setdefault(whole[a:b], len(place)) for a, b in zip(cut, cut[1:])])
        v = vocabulary(ranks_path, pattern)
        ids, kind = v.replayed(list(place)), v.kind
        made = [[ids[k] for k in x] for x in of]
        return pa.table({
            "unit": table.column("unit"), "bucket": table.column("bucket"),
            "ids": pa.array([np.fromiter(chain.from_iterable(x), kind).tobytes() for x in made], pa.binary()),
            "counts": pa.array([np.fromiter(map(len, x), np.int32).tobytes() for x in made], pa.binary()),
        })

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        v = vocabulary(ranks_path, pattern)
        rows = opened(table)
        place: dict[str, int] = {}
        cuts = [np.fromiter([place.setdefault(p, len(place)) for p in v.find(t.as_py())], np.int32) for t in rows.column(text_at)]
        pieces = _ranged(place, n)
        at, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        flat = cells(back.column("ids"), v.kind)
        before = 0
        for k, ids, own in zip(back.column("bucket").to_pylist(), flat, cells(back.column("counts"), np.int32)):
            of = np.fromiter(map(place.__getitem__, pieces[k]), np.int64, len(own))
            at[of], size[of] = before + np.cumsum(own) - own, own
            before += len(ids)
        known = np.concatenate([*flat, np.empty(0, v.kind)])
        count, first, second = [], [], []
        start = 0
        while start < len(cuts):
            stop, pieces_left = start + 1, AT_ONCE - len(cuts[start])
            while stop < len(cuts) and (pieces_left := pieces_left - len(cuts[stop])) >= 0:
                stop += 1
            some = cuts[start:stop]
            c = np.concatenate(some)
            ids = known[_runs(at[c], size[c])]
            spelt, width = v.decoded(ids)
            # ends of texts in pieces, ids and bytes
            ends = np.cumsum([len(x) for x in some])
            ends = np.concatenate([[0], np.cumsum(size[c])])[ends]
            byte_ends = np.concatenate([[0], np.cumsum(width)])[ends]
            cut, byte_cut = np.concatenate([[0], ends]), np.concatenate([[0], byte_ends])
            count += np.diff(cut).tolist()
            if digests:
                wide, spelt = ids.astype("<u4"), spelt.tobytes()
                first += [hashlib.sha256(wide[x:y]).hexdigest() for x, y in zip(cut, cut[1:])]
                second += [hashlib.sha256(spelt[x:y]).hexdigest() for x, y in zip(byte_cut, byte_cut[1:])]
            else:
                first.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))))
                spelt = spelt.tobytes()
                second.append(pa.array([spelt[x:y] for x, y in zip(byte_cut, byte_cut[1:])], pa.binary()))
            start = stop
        kinds = (pa.list_(pa.int32()), pa.binary())
        made = [pa.array(first, pa.string()), pa.array(second, pa.string())] if digests else [pa.chunked_array(x, k) for x, k in zip((first, second), kinds)]
        return pa.table([*[rows.column(i) for i in range(text_at)], pa.array(count, pa.int64()), *made], names=names)

    given = units.groupBy("unit").applyInArrow(send, "unit long, bucket long, pieces binary, lengths binary").groupBy("bucket").applyInArrow(encode, "unit long, bucket long, ids binary, counts binary")
    return units.groupBy("unit").cogroup(given.groupBy("unit")).applyInArrow(finish, ", ".join([*kinds, body]))
