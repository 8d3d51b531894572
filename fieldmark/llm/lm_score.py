"""Language-model scores: a unigram base and a hashed maximum-entropy model with word classes.

Two parts make up the model, both factored into a class and a word given the class.

*Classes.*  P(class | classes before) * P(token | class).  Classes are the end of a text, the ``SINGLES`` most
frequent tokens on their own, and ``SHAPES`` groups of the rest by a hash of their spelling; within a
class, tokens have smoothed relative frequencies with half a count for each known token and one
unknown.  The class is predicted by a maximum-entropy model whose features (bias, previous class,
previous two classes, the class before the last skipped over) are hashed into ``FEATURES`` rows of weights,
with one softmax over the classes.  Every round the partitions' gradients are summed by feature
(a table of fixed size) and the weights updated.

*Words.*  Features (two words before, word), hashed; those seen ``LEAST`` times or more in training have a
weight, so their number grows with the corpus.  For each
history, a softmax over the hash classes of its words and "another word", and one over the words in
a class, are trained by gradients with a Gaussian prior.  They live where their history's hash range lives:
no weight leaves it but to the units whose texts need it.  "Another word" leads to the class model, so
probabilities of all tokens sum to one but for hash collisions: P = a + e * P_class, with a the word's
own probability and e that of another word.

Counting: texts are dealt once into units; a unit sends its distinct tokens with counts to hash
ranges, which return the corpus count of each, so a frequent token costs one entry a unit; features
likewise, by the history's range.  Scoring looks all of it up in numpy batches.

Edge cases: null texts count as empty (only the end token); rows with a null id train; without
training rows all scores follow from zero counts; repeated rows each count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RANGE_BYTES, bucket_of, cells, chunks, dealt, stored
from .words import mix, words

SINGLES, SHAPES = 47, 16
CLASSES = 1 + SINGLES + SHAPES
FEATURES = 1 << 13
PARTS = 32
ROUNDS = 12
END = np.uint64(0x5851F42D4C957F2D)
START, SEED = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA24BAED4963EE407)
#: Text to a range of histories.
PAST_BYTES = 8 << 20
#: Bits of a word's hash within a history, hash classes of words there, least count of a feature, prior variance, rounds.
WORD_BITS, GROUPS, LEAST, PRIOR, STEPS = 16, 64, 2, 4.0, 12

_SENT = "bucket long, unit long, hashes binary, counts binary, shapes binary"
_COUNTED = "unit long, bucket long, counts binary, n long, v long, shape_n array<long>, shape_v array<long>, top_hash array<long>, top_n array<long>, top_shape array<long>"


def _shape(w) -> np.ndarray:
    """Spelling group of each word: from its last byte that isn't ASCII, else its last byte."""
    wide = np.flatnonzero(w.data >= 128)
    last = w.end - 1
    if len(wide):
        at = wide[np.maximum(np.searchsorted(wide, w.end) - 1, 0)]
        last = np.where((at >= w.start) & (at < w.end), at, last)
    return (mix(w.data[last].astype(np.uint64)) % np.uint64(SHAPES)).astype(np.uint8)


class _Unit:
    """Tokens of a unit's texts, each followed by its end token; ``which`` indexes the sorted distinct ``hash``."""

    def __init__(self, table: pa.Table):
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        hashes, shapes, counts = [], [], []
        for a, b in chunks(text):
            w = words(text.slice(a, b - a), lower=True)
            at = w.first[1:]
            hashes.append(np.insert(w.hash, at, END))
            shapes.append(np.insert(_shape(w), at, 0))
            counts.append(w.counts() + 1)
        self.counts = np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.held = np.asarray(table.column("held").combine_chunks().to_numpy(zero_copy_only=False), bool)
        token = np.concatenate(hashes)
        self.hash, pick, self.which = np.unique(token, return_index=True, return_inverse=True)
        self.shape = np.concatenate(shapes)[pick]
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def classes(self, singles: np.ndarray) -> np.ndarray:
        """Class of each distinct token; ``singles``: sorted hashes."""
        out = 1 + SINGLES + self.shape.astype(np.int64)
        if len(singles):
            at = np.minimum(np.searchsorted(singles, self.hash), len(singles) - 1)
            out = np.where(singles[at] == self.hash, 1 + at, out)
        out[self.hash == END] = 0
        return out

    def history(self, cls: np.ndarray) -> np.ndarray:
        """class two before * CLASSES + class before, for each token; 0 before a text's start."""
        c = cls[self.which]
        one, two = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        one[1:], two[2:] = c[:-1], c[:-2]
        one[self.first[:-1]] = two[self.first[:-1]] = 0
        second = self.first[:-1][self.counts > 1] + 1
        two[second] = 0
        return two * CLASSES + one


class _Histories:
    """A unit's word features: distinct histories in order of their hash, and in each its distinct words.

    ``bits`` of a history's hash are kept, enough to tell histories of one range apart.  ``token`` is the
    feature of each token.
    """

    def __init__(self, u: _Unit, n: int):
        bits = np.uint64(min(64, 33 + int(n).bit_length()))
        h = u.hash[u.which]
        one, two = np.empty_like(h), np.empty_like(h)
        one[1:], two[2:] = h[:-1], h[:-2]
        start = u.first[:-1]
        one[start] = START
        two[start] = START
        two[start[u.counts > 1] + 1] = START
        past = mix(mix(two ^ SEED) ^ one) >> (np.uint64(64) - bits)
        word = (mix(h ^ SEED) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        self.past, at = np.unique(past, return_inverse=True)
        pair, self.token = np.unique((at << WORD_BITS) | word, return_inverse=True)
        self.count = np.bincount(self.token[~u.held[u.doc]], minlength=len(pair)).astype(np.int64)
        self.word = (pair & ((1 << WORD_BITS) - 1)).astype(np.int64)
        self.words = np.bincount(pair >> WORD_BITS, minlength=len(self.past)).astype(np.int64)
        self.range = bucket_of(self.past << (np.uint64(64) - bits), n)

    def slices(self, n: int):
        """(range, histories, words) for each range with any."""
        cut = np.searchsorted(self.range, np.arange(n + 1))
        end = np.concatenate([[0], np.cumsum(self.words)])
        for b in np.flatnonzero(np.diff(cut)).tolist():
            yield b, slice(cut[b], cut[b + 1]), slice(end[cut[b]], end[cut[b + 1]])


def planes(x: np.ndarray, width: int) -> bytes:
    """An array's low ``width`` bytes, byte by byte, which compresses well where high bytes repeat."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :width].T).tobytes()


def unplaned(body, dtype, width: int) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = raw.T
    return out.view(dtype).ravel()


def learn(past: np.ndarray, word: np.ndarray, count: np.ndarray, rounds: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """For each history (sorted index ``past`` of each feature) P(another word), and each feature's probability (0 below ``LEAST``).

    Softmaxes over a history's word classes with "another word", whose weight is 0, and over a class's
    words: steps along the gradient of the penalised log-likelihood, scaled by its curvature.
    """
    total = np.bincount(past, weights=count)
    own = np.flatnonzero(count >= LEAST)
    other, p = np.ones(len(total)), np.zeros(len(count))
    if not len(own):
        return other, p
    group = past[own] * GROUPS + word[own] % GROUPS
    order = np.argsort(group, kind="stable")
    own, group = own[order], group[order]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(group))))  # class of each word
    at = group[head] // GROUPS  # history of each class
    n_word = count[own].astype(float)
    n_class = np.add.reduceat(n_word, head)
    n_past = total[at]
    lam, kap = np.zeros(len(own)), np.zeros(len(head))
    for _ in range(rounds):
        w = np.exp(lam)
        pw = w / np.add.reduceat(w, head)[of]
        lam += (n_word - n_class[of] * pw - lam / PRIOR) / (n_class[of] * pw * (1 - pw) + 1 / PRIOR + 0.25)
        k = np.exp(kap)
        pc = k / (1 + np.bincount(at, weights=k, minlength=len(total)))[at]
        kap += (n_class - n_past * pc - kap / PRIOR) / (n_past * pc * (1 - pc) + 1 / PRIOR + 0.25)
        lam, kap = np.clip(lam, -12, 12), np.clip(kap, -12, 25)
    w, k = np.exp(lam), np.exp(kap)
    z = 1 + np.bincount(at, weights=k, minlength=len(total))
    p[own] = (w / np.add.reduceat(w, head)[of]) * (k / z[at])[of]
    return 1 / z, p


_HELD = "bucket long, unit long, past binary, words binary, word binary, count binary"
_GIVEN = "unit long, bucket long, other binary, own binary"


def sparse(x: np.ndarray, blank: float, dtype) -> bytes:
    """Which entries aren't ``blank``, bit by bit, and these."""
    full = x != blank
    return np.uint32(len(x)).tobytes() + np.packbits(full).tobytes() + x[full].astype(dtype).tobytes()


def dense(body, blank: float, dtype) -> np.ndarray:
    n = int(np.frombuffer(body, np.uint32, 1)[0])
    cut = 4 + -(-n // 8)
    out = np.full(n, blank)
    out[np.unpackbits(np.frombuffer(body, np.uint8)[4:cut], count=n).view(bool)] = np.frombuffer(bytes(memoryview(body)[cut:]), dtype)
    return out


def _word_weights(docs: DataFrame, n: int) -> DataFrame:
    """(unit, bucket, other, own): probabilities of a unit's histories and features, from all training texts."""

    def send(table: pa.Table) -> pa.Table:
        x = _Histories(_Unit(table), n)
        rows = list(x.slices(n))
        unit = table.column("unit")[0].as_py()
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int64()), "unit": pa.array([unit] * len(rows), pa.int64()),
            "past": pa.array([planes(np.diff(x.past[h], prepend=np.uint64(0)), 8) for _, h, _ in rows], pa.binary()),
            "words": pa.array([planes(x.words[h], 4) for _, h, _ in rows], pa.binary()),
            "word": pa.array([planes(x.word[w], 2) for _, _, w in rows], pa.binary()),
            "count": pa.array([planes(x.count[w], 4) for _, _, w in rows], pa.binary()),
        })

    def give(table: pa.Table) -> pa.Table:
        get = lambda name, dtype, width: [unplaned(x.as_buffer(), dtype, width) for x in table.column(name)]
        past, words_, word, count = get("past", np.uint64, 8), get("words", np.int64, 4), get("word", np.int64, 2), get("count", np.int64, 4)
        past = [np.cumsum(x) for x in past]
        every, at = np.unique(np.concatenate(past), return_inverse=True)
        at = np.repeat(at, np.concatenate(words_))  # history of each unit's feature
        pair, which = np.unique((at << WORD_BITS) | np.concatenate(word), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(count)).astype(np.int64)
        _, own = learn(pair >> WORD_BITS, pair & ((1 << WORD_BITS) - 1), total)
        own = own.astype(np.float16).astype(float)  # as sent; another word has what is left
        other = np.clip(1 - np.bincount(pair >> WORD_BITS, weights=own), 1e-7, 1)
        own = np.split(own[which], np.cumsum([len(x) for x in word])[:-1])
        other = [other[np.searchsorted(every, x)] for x in past]
        return pa.table({
            "unit": table.column("unit"), "bucket": table.column("bucket"),
            "other": pa.array([sparse(x, 1.0, np.float32) for x in other], pa.binary()), "own": pa.array([sparse(x, 0.0, np.float16) for x in own], pa.binary()),
        })

    return docs.groupBy("unit").applyInArrow(send, _HELD).groupBy("bucket").applyInArrow(give, _GIVEN)


def _features(history: np.ndarray) -> np.ndarray:
    """Weight rows of each history: bias, bigram, trigram, skip."""
    two, one = history // CLASSES, history % CLASSES
    zero = np.zeros_like(one)
    keys = np.stack([zero, 1 + one, 1000 + history, 100_000 + two], axis=1).astype(np.uint64)
    return (mix(keys) % np.uint64(FEATURES)).astype(np.int64)


def _log_softmax(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    z = weights[_features(history)].sum(axis=1)
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _count(docs: DataFrame, n: int) -> DataFrame:
    def send(table: pa.Table) -> pa.Table:
        u = _Unit(table)
        c = np.bincount(u.which[~u.held[u.doc]], minlength=len(u.hash)).astype(np.int32)
        cut = np.searchsorted(bucket_of(u.hash, n), np.arange(n + 1))
        full = np.flatnonzero(np.diff(cut))
        part = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())
        unit = pa.array(np.full(len(full), table.column("unit")[0].as_py(), np.int64))
        return pa.table({"bucket": pa.array(full, pa.int64()), "unit": unit, "hashes": part(u.hash), "counts": part(c), "shapes": part(u.shape)})

    def add(table: pa.Table) -> pa.Table:
        hashes = cells(table.column("hashes"), np.uint64)
        h, pick, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        c = np.bincount(which, weights=np.concatenate(cells(table.column("counts"), np.int32))).astype(np.int64)
        shape = np.concatenate(cells(table.column("shapes"), np.uint8))[pick]
        cut = np.cumsum([len(x) for x in hashes])[:-1]
        body = [x.tobytes() for x in np.split(c[which], cut)]
        word = h != END
        top = np.lexsort((h[word], -c[word]))[:SINGLES]
        top = top[c[word][top] > 0]
        m = len(body)
        whole = [
            ("n", [int(c.sum())]), ("v", [int((c > 0).sum())]),
            ("shape_n", [np.bincount(shape[word], weights=c[word], minlength=SHAPES).astype(np.int64).tolist()]),
            ("shape_v", [np.bincount(shape[word], weights=c[word] > 0, minlength=SHAPES).astype(np.int64).tolist()]),
            ("top_hash", [h[word][top].astype(np.int64).tolist()]), ("top_n", [c[word][top].tolist()]), ("top_shape", [shape[word][top].tolist()]),
        ]
        kinds = dict(n=pa.int64(), v=pa.int64(), **{k: pa.list_(pa.int64()) for k in ("shape_n", "shape_v", "top_hash", "top_n", "top_shape")})
        return pa.table({
            "unit": pa.array([*table.column("unit").to_pylist(), -1], pa.int64()),
            "bucket": pa.array([table.column("bucket")[0].as_py()] * (m + 1), pa.int64()),
            "counts": pa.array([*body, None], pa.binary()),
            **{k: pa.array([*[None] * m, *v], kinds[k]) for k, v in whole},
        })

    return docs.groupBy("unit").applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(add, _COUNTED)


def _histories(docs: DataFrame, singles: np.ndarray) -> DataFrame:
    """(part, codes, counts): training counts of history * CLASSES + class."""

    def pack(code: np.ndarray, count: np.ndarray) -> pa.Table:
        part = (code // CLASSES) % PARTS
        full = np.unique(part)
        made = lambda x, t: pa.array([x[part == p].astype(t).tobytes() for p in full], pa.binary())
        return pa.table({"part": pa.array(full, pa.int64()), "codes": made(code, np.int32), "counts": made(count, np.int64)})

    def count(table: pa.Table) -> pa.Table:
        u = _Unit(table)
        cls = u.classes(singles)
        code = u.history(cls) * CLASSES + cls[u.which]
        return pack(*np.unique(code[~u.held[u.doc]], return_counts=True))

    def add(table: pa.Table) -> pa.Table:
        code, which = np.unique(np.concatenate(cells(table.column("codes"), np.int32)), return_inverse=True)
        return pack(code.astype(np.int64), np.bincount(which, weights=np.concatenate(cells(table.column("counts"), np.int64))))

    kind = "part long, codes binary, counts binary"
    return docs.groupBy("unit").applyInArrow(count, kind).groupBy("part").applyInArrow(add, kind)


def _train(seen: DataFrame, rounds: int) -> np.ndarray:
    """Weights, from feature totals summed over the partitions of ``seen`` in every round."""

    def totals(weights: np.ndarray | None) -> np.ndarray:
        """Of each feature and class: counts seen or, given weights, counts expected."""

        def run(batches):
            total = np.zeros((FEATURES, CLASSES))
            for batch in batches:
                for code, n in zip(cells(batch.column("codes"), np.int32), cells(batch.column("counts"), np.int64)):
                    history, which = np.unique(code // CLASSES, return_inverse=True)
                    real = np.zeros((len(history), CLASSES))
                    real[which, code % CLASSES] = n
                    if weights is not None:
                        real = real.sum(axis=1, keepdims=True) * np.exp(_log_softmax(weights, history))
                    for f in _features(history).T:
                        np.add.at(total, f, real)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["f", "g"])

        sums = [F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(CLASSES)]
        got = seen.select("codes", "counts").mapInArrow(run, "f long, g array<double>").groupBy("f").agg(*sums).toPandas()
        out = np.zeros((FEATURES, CLASSES))
        out[got["f"].to_numpy(np.int64)] = got.drop(columns="f").to_numpy()
        return out

    weights, speed = np.zeros((FEATURES, CLASSES)), 0.0
    real = totals(None)
    for _ in range(rounds):
        expected = totals(weights)
        # the gradient of the log-likelihood, scaled by its own size as in iterative scaling
        speed = 0.5 * speed + 0.35 * np.clip((real - expected) / (expected + 2), -1, 1)
        weights = weights + speed
    return weights


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Score all rows, learning from those whose crc32(id as text) mod ``folds`` is not ``held``.

    Per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` (log10 probabilities of the whole text).
    """
    parts, n, spans = dealt(df, text_col, RANGE_BYTES, PAST_BYTES)
    text = F.coalesce(F.col(text_col), F.lit(""))
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))
    docs = df.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(parts)).alias("unit"), F.col(id_col).alias("id"), held_out.alias("held"), text.alias("text"))
    counted = stored(_count(docs, n), "counts")
    stats = counted.where("unit = -1")
    whole = stats.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"),
        *[F.coalesce(F.sum(F.col(k)[i]), F.lit(0)).alias(f"{k}{i}") for k in ("shape_n", "shape_v") for i in range(SHAPES)],
    ).first()
    top = stats.select(F.explode(F.arrays_zip("top_hash", "top_n", "top_shape")).alias("t")).select("t.*").orderBy(F.desc("top_n"), "top_hash").limit(SINGLES).collect()
    top = sorted((t["top_hash"] % (1 << 64), t["top_n"], t["top_shape"]) for t in top)
    singles = np.array([h for h, _, _ in top], np.uint64)
    weights = _train(stored(_histories(docs, singles), "histories"), rounds)

    # tokens and distinct tokens of each class: the end, single tokens, groups without the single ones
    total, distinct = whole["n"], whole["v"]
    n_cls, v_cls = np.zeros(CLASSES), np.zeros(CLASSES)
    for i in range(SHAPES):
        n_cls[1 + SINGLES + i], v_cls[1 + SINGLES + i] = whole[f"shape_n{i}"], whole[f"shape_v{i}"]
    n_cls[0] = total - n_cls.sum()
    v_cls[0] = n_cls[0] > 0
    for i, (_, m, shape) in enumerate(top):
        n_cls[1 + i], v_cls[1 + i] = m, 1
        n_cls[1 + SINGLES + shape] -= m
        v_cls[1 + SINGLES + shape] -= 1
    idt = docs.schema["id"].dataType.simpleString()
    out = f"id {idt}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        u = _Unit(table)
        kind, bucket = back.column("kind").to_numpy(), back.column("bucket").to_numpy()
        order = np.argsort(bucket, kind="stable")
        body = cells(back.column("counts"), np.int64)
        c = np.concatenate([body[i] for i in order if kind[i] == 0]).astype(float)
        cls = u.classes(singles)
        base = np.log10(c + 0.5) - np.log10(total + 0.5 * (distinct + 1))
        inner = np.log10(c + 0.5) - np.log10(n_cls[cls] + 0.5 * (v_cls[cls] + 1))
        outer = _log_softmax(weights, np.arange(CLASSES * CLASSES)) / np.log(10)
        size = len(u.counts)
        p = 10.0 ** (inner[u.which] + outer[u.history(cls), cls[u.which]])
        x = _Histories(u, spans)
        get = lambda name, *how: np.concatenate([dense(back.column(name)[int(i)].as_buffer(), *how) for i in order if kind[i] == 1])
        past = np.repeat(np.arange(len(x.past)), x.words)
        p = get("own", 0.0, np.float16)[x.token] + get("other", 1.0, np.float32)[past[x.token]] * p
        summed = lambda x: pa.array(np.bincount(u.doc, weights=x, minlength=size))
        return pa.table({
            "id": table.column("id"),
            "held_out": pa.array(u.held),
            "n_tokens": pa.array(u.counts, pa.int64()),
            "n_known": summed((c > 0)[u.which]).cast(pa.int64()),
            "train_tokens": pa.array(np.full(size, total, np.int64)),
            "base_score": summed(base[u.which]),
            "score": summed(np.log10(p)),
        })

    blank = lambda *names: [F.lit(None).cast("binary").alias(x) for x in names]
    back = counted.where("unit >= 0").select("unit", "bucket", F.lit(0).alias("kind"), "counts", *blank("other", "own"))
    given = _word_weights(docs, spans).select("unit", "bucket", F.lit(1).alias("kind"), *blank("counts"), "other", "own")
    back = back.unionByName(given)
    return docs.groupBy("unit").cogroup(back.groupBy("unit")).applyInArrow(run, out).withColumnRenamed("id", id_col)
