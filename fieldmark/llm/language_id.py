"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of what isn't a letter or mark becomes one space, and the pairs and triples of code
points in the result, boundaries included, are hashed into ``2**BITS`` features.  Document frequencies are counted
over all training texts.  A term weighs (1 + ln count) * idf, a text's weights are scaled to length one.  The weights of the
regression are fitted by follow-the-regularised-leader with an elastic net in mini-batches, so that most are
exactly zero; then a temperature is fitted on texts that the fit hasn't seen.  Texts are scored whole, in numpy
batches; scoring reads nothing but the text.

The fit uses a bounded sample of the labelled texts: ``SAMPLE`` distinct texts and ``SAMPLE_BYTES`` bytes in
expectation, shared equally by the languages and drawn by hash; one task fits, on nothing larger.
Everything else covers all rows.

Edge cases: texts that are null or without a letter are ``und`` with score 0, and so is every text where
nothing can be learned; with one language learned it is predicted with score 1; rows with a null id train; null languages
don't; copies of a text count for frequencies each, and once in the sample; ties go to the first language by code point;
columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, chunks, drop, stored
from .words import mix

BITS = 18
SAMPLE, SAMPLE_BYTES = 6_000, 24 << 20
#: Learning rate, its damping, elastic net, texts of a mini-batch, passes over the sample.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 0.02
BATCH, EPOCHS = 32, 4
#: One in so many texts of the sample is kept for the temperature.
APART = 5
UNKNOWN = "und"
TOP = 0x32400  # no letter lies beyond


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case, 32 for what isn't a letter or mark; whether it is a letter."""
    low = np.full(TOP + 1, 32, np.uint64)
    letter = np.zeros(TOP + 1, bool)
    for i in range(TOP):
        kind = unicodedata.category(c := chr(i))[0]
        if kind in "LM":
            low[i] = ord(x) if len(x := c.lower()) == 1 else i
            letter[i] = kind == "L"
    return low, letter


class Terms(NamedTuple):
    first: np.ndarray  # index of each text's first term, and the number of all
    term: np.ndarray  # features of each text, ascending
    count: np.ndarray
    letters: np.ndarray  # whether a text has a letter


def terms(text: pa.Array, bits: int = BITS) -> Terms:
    """The features of each text of a null-free column with their counts."""
    data, off = bytes_of(text)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n = len(text)
    low, letter = _letters()
    at = np.minimum(points, TOP)
    ends = lead[off]  # in code points
    doc = np.repeat(np.arange(n), np.diff(ends))
    has = np.zeros(n, bool)
    has[doc[letter[at]]] = True
    # a space before each text and after the last
    line = np.full(len(points) + n + 1, 32, np.uint64)
    line[np.arange(len(points)) + doc + 1] = low[at]
    owner = np.append(np.repeat(np.arange(n), np.diff(ends) + 1), n)
    solid = line != 32
    keep = solid | (owner != np.concatenate([[-1], owner[:-1]]))
    keep[1:] |= solid[:-1]
    line, owner = line[keep], owner[keep]
    # where a text ends in a letter, the next one's first space stands for its boundary
    pair = (line[:-1] << np.uint64(21)) | line[1:]
    triple = (pair[:-1] << np.uint64(21)) | line[2:]
    keys = []
    for grams, width in ((pair, 2), (triple, 3)):
        k = len(grams)
        inner = (owner[:k] == owner[width - 2 : width - 2 + k]) & (owner[:k] < n)
        space = line == 32
        inner &= ~(space[:-1] & space[1:])[width - 2 : width - 2 + k]  # the end of a text and the start of the next
        inner &= ~(space[:-1] & space[1:])[:k]
        f = mix(grams[inner] ^ np.uint64(width << 61)) >> np.uint64(64 - bits)
        keys.append((owner[:k][inner].astype(np.uint64) << np.uint64(bits)) | f)
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.diff(key, prepend=np.uint64(2**64 - 1)))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    first = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(bits))
    return Terms(first, (key & np.uint64((1 << bits) - 1)).astype(np.int64), count, has)


def weighted(t: Terms, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of each term, texts scaled to length one."""
    w = (1 + np.log(t.count)) * idf[t.term]
    doc = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    # summed text by text, so that rounding doesn't depend on a text's neighbours
    return w / np.sqrt(np.bincount(doc, w * w, minlength=len(t.first) - 1))[doc]


def frequencies(texts: DataFrame, bits: int = BITS) -> tuple[int, np.ndarray]:
    """(texts, document frequency of each feature) over all rows of (text); ``2**bits`` counts come to the driver."""

    def run(batches):
        total, n = np.zeros(1 << bits, np.int64), 0
        for b in batches:
            column = b.column("text")
            for start, stop in chunks(column):
                total += np.bincount(terms(column.slice(start, stop - start), bits).term, minlength=1 << bits)
            n += len(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["term", "n"])

    out, n = np.zeros(1 << bits, np.int64), 0
    for batch in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_batches():
        term, count = (batch.column(i).to_numpy() for i in (0, 1))
        n += int(count[term < 0].sum())
        out[term[term >= 0]] = count[term >= 0]
    return n, out


class Model(NamedTuple):
    langs: list[str]
    idf: np.ndarray  # of each feature
    used: np.ndarray  # features with weights that aren't all 0, ascending
    weights: np.ndarray  # (used, langs)
    bias: np.ndarray
    temperature: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, a coordinate at a time: (features, classes) and an unpenalised bias."""

    def __init__(self, features: int, classes: int, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.l1, self.l2 = np.full(features + 1, l1), np.full(features + 1, l2)
        self.l1[-1] = self.l2[-1] = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at][:, None]
        scale = (BETA + np.sqrt(self.n[at])) / ALPHA + self.l2[at][:, None]
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / scale, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One mini-batch: ``x`` (texts, features ``at``), ``y`` one-hot."""
        w = self.weights(at)
        g = x.T @ (softmax(x @ w) - y)
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = more


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least log-loss, by golden section in its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = logits / math.exp(t)
        top = z.max(1)
        return float((top + np.log(np.exp(z - top[:, None]).sum(1)) - z[np.arange(len(y)), y]).mean()) + 1e-4 * t * t

    a, b, r = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def fitted(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, features: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(used, weights, bias, temperature) from rows (class, features, weights)."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    # the temperature's part has texts of every language, or none
    apart = set(order[:: APART].tolist()) if len(rows) >= 10 * APART else set()
    learner = Ftrl(features, classes)
    fit = np.array([i for i in order if i not in apart], np.int64)

    def dense(some, at):
        x = np.zeros((len(some), len(at) + 1))
        x[:, -1] = 1.0
        for k, i in enumerate(some):
            x[k, np.searchsorted(at, rows[i][1])] = rows[i][2]
        return x

    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for i in range(0, len(fit), BATCH):
            some = fit[i : i + BATCH]
            at = np.unique(np.concatenate([rows[j][1] for j in some]))
            learner.learn(np.append(at, features), dense(some, at), np.eye(classes)[[rows[j][0] for j in some]])
    every = learner.weights(np.arange(features + 1))
    used = np.flatnonzero((every[:-1] != 0).any(1))
    held = sorted(apart)
    logits = np.array([every[rows[i][1]].T @ rows[i][2] + every[-1] for i in held]).reshape(len(held), classes)
    return used, every[used], every[-1], temperature(logits, np.array([rows[i][0] for i in held], np.int64))


def learned(labelled: DataFrame, bits: int = BITS, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """The model of rows (text, lang), both null-free; None without rows."""
    stats = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row a language
    if not stats:
        return None
    langs = sorted(r["lang"] for r in stats)
    n, df = frequencies(labelled.select("text"), bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = {r["lang"]: min(1.0, sample / len(langs) / r["n"], sample_bytes / len(langs) / max(r["bytes"], 1)) for r in stats}
    under = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(int(v * (1 << 40))))])
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(7), "key", "text"), 24)
    drawn = labelled.where(hashed < F.element_at(under, F.col("lang"))).select("lang", "text").distinct()
    place = {c: i for i, c in enumerate(langs)}

    def run(batches):
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []
        for b in batches:
            column, lang = b.column("text"), b.column("lang").to_pylist()
            for start, stop in chunks(column):
                t = terms(column.slice(start, stop - start), bits)
                w = weighted(t, idf)
                for i in range(stop - start):
                    if t.letters[i]:
                        at = slice(t.first[i], t.first[i + 1])
                        rows.append((place[lang[start + i]], t.term[at].copy(), w[at].copy()))
        used, weights, bias, temp = fitted(rows, len(langs), 1 << bits) if rows else (np.empty(0, np.int64), np.empty((0, len(langs))), np.zeros(len(langs)), 1.0)
        cell = lambda x, kind: pa.array([np.ascontiguousarray(x).astype(kind).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([cell(used, "<i8"), cell(weights, "<f8"), cell(bias, "<f8"), pa.array([temp]), pa.array([len(rows)])], names=["used", "weights", "bias", "temperature", "rows"])

    # sorted, so that equal tables give equal models however their rows were dealt out
    model = stored(drawn.repartition(1).sortWithinPartitions("lang", "text").mapInArrow(run, "used binary, weights binary, bias binary, temperature double, rows long"), "language_model")
    got = model.where("rows > 0").collect()
    drop(model)
    if not got:
        return None
    r = got[0]
    weights = np.frombuffer(r["weights"], "<f8").reshape(-1, len(langs))
    return Model(langs, idf, np.frombuffer(r["used"], "<i8"), weights, np.frombuffer(r["bias"], "<f8"), r["temperature"])


def scored(text: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text of a null-free column."""
    bits = int(len(model.idf)).bit_length() - 1
    n, k = len(text), len(model.langs)
    t = terms(text, bits)
    w = weighted(t, model.idf)
    place = np.full(len(model.idf), -1, np.int64)
    place[model.used] = np.arange(len(model.used))
    at = place[t.term]
    hit = np.flatnonzero(at >= 0)
    doc = np.repeat(np.arange(n), np.diff(t.first))[hit]
    z = np.stack([np.bincount(doc, w[hit] * model.weights[at[hit], c], minlength=n) for c in range(k)], axis=1) + model.bias
    p = softmax(z / model.temperature)
    best = p.argmax(1)
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, t.letters)], np.where(t.letters, p[np.arange(n), best], 0.0)


def identified(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2,
    bits: int = BITS, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, learning from rows whose crc32(id as text) mod ``folds`` isn't ``held``."""
    key = F.col(id_col).cast("string")
    held_out = F.coalesce(F.crc32(key) % folds == held, F.lit(False))
    own = df.select(F.col(id_col).alias("id"), F.coalesce(key, F.lit("")).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out"))
    model = learned(own.where("not held_out and lang is not null").select("key", "text", "lang"), bits, sample, sample_bytes)

    def run(batches):
        for b in batches:
            column = b.column("text")
            lang, p = [], []
            for start, stop in chunks(column):
                some, q = scored(column.slice(start, stop - start), model) if model else ([UNKNOWN] * (stop - start), np.zeros(stop - start))
                lang += some
                p.append(q)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(np.concatenate(p) if p else np.empty(0))], names=["id", "held_out", "lang_pred", "score"])

    kind = own.schema["id"].dataType.simpleString()
    return own.select("id", "held_out", "text").mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
