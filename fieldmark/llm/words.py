"""Words ``[^\\x20\\x09-\\x0D]+`` of Arrow text columns and their hashes, without a Python loop.

A word's hash runs over its bytes eight at a time, each lane passed through a bit mixer before the
next one goes in; words over ``LONG`` bytes take BLAKE2.  Window hashes mix the hashes of two halves,
doubling the width.  Nothing is linear in the bytes, so equal hashes of different sequences are a
matter of chance: about n*n / 2^65 of n different ones, and n*n / 2^129 where ``wide`` asks for a
second, independent hash.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .common import bytes_of

LONG = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit integers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Masks of the first k bytes of a little-endian lane.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Words(NamedTuple):
    hash: np.ndarray  # of each word of all texts
    first: np.ndarray  # index of each text's first word, and the number of all words
    data: np.ndarray  # bytes of the texts (as hashed)
    start: np.ndarray  # byte range of each word
    end: np.ndarray
    wide: np.ndarray | None = None  # a second hash of each word, where asked for

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64) -> np.ndarray:
    lanes = np.ndarray((len(data),), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    size = end - start
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * _GOLD + seed)
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        lane = lanes[start[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]
        h[at] = mix(h[at] ^ lane)
    key = int(seed).to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def words(text: pa.Array, lower: bool = False, wide: bool = False) -> Words:
    """Words of a null-free text column; ``lower`` folds A-Z first, ``wide`` adds the second hash."""
    data, off = bytes_of(text)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        e, none = np.empty(0, np.int64), np.empty(0, np.uint64)
        return Words(none, np.zeros(len(off), np.int64), data, e, e, none if wide else None)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    one, two = (_hashed(data, start, end, seed) if seed == _SEEDS[0] or wide else None for seed in _SEEDS)
    return Words(one, np.searchsorted(start, off), data, start, end, two)


def starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words inside one text, and their texts' indices."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # words from here to the text's end
    at = np.flatnonzero(left >= size)
    return at, np.searchsorted(first, at, "right") - 1


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries (across texts as well)."""
    out, width = h, 1
    while width < size and len(out):
        step = min(width, size - width)
        out = mix(mix(out[: max(len(out) - step, 0)]) ^ out[step:])
        width += step
    return out


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, their first words, their texts' indices."""
    at, doc = starts(first, size)
    return rolled(h, size)[at], at, doc


def sequence_hash(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of the whole word sequence of each text of fewer than ``size`` words (0 for others)."""
    counts = np.diff(first)
    out = np.where(counts < size, mix(counts.astype(np.uint64) ^ _SEEDS[1]), np.uint64(0))
    for k in range(size - 1):
        at = np.flatnonzero((counts > k) & (counts < size))
        out[at] = mix(mix(out[at]) ^ h[first[at] + k])
    return out
