"""Language identification: terms by brute force, held-out accuracy, awkward rows."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import language_id, queries
from fieldmark.llm.words import mix

TEXTS = ["Ab c", "", "é", "  12 x!y ", "a" * 50, "ß Straße", "日本 語", "İx", "ab\ncd", "1 2 3"]


def grams(t):
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in t)
    line = " " + " ".join(low.split()) + (" " if low.split() else "")
    return Counter(line[i : i + k] for k in (2, 3) for i in range(len(line) - k + 1))


def feature(g):
    key = 0
    for c in g:
        key = (key << 21) | ord(c)
    return int(mix(np.array([key ^ (len(g) << 61)], np.uint64))[0] >> np.uint64(64 - language_id.BITS))


def test_terms_against_strings():
    t = language_id.terms(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        want = Counter()
        for g, n in grams(text).items():
            want[feature(g)] += n
        at = slice(t.first[i], t.first[i + 1])
        assert dict(zip(t.term[at].tolist(), t.count[at].tolist())) == dict(want), text
        assert t.letters[i] == any(c.isalpha() for c in text)


def test_frequencies_and_weights(spark):
    n, df = language_id.frequencies(spark.createDataFrame([(t,) for t in TEXTS + TEXTS[:3]], "text string"))
    want = Counter(f for t in TEXTS + TEXTS[:3] for f in {feature(g) for g in grams(t)})
    assert n == 13 and {i: int(df[i]) for i in np.flatnonzero(df)} == dict(want)
    idf = np.log((1 + n) / (1 + df)) + 1
    t = language_id.terms(pa.array(TEXTS))
    w = language_id.weighted(t, idf)
    raw = {feature(g): (1 + math.log(c)) * idf[feature(g)] for g, c in grams("Ab c").items()}
    size = math.sqrt(sum(v * v for v in raw.values()))
    assert dict(zip(t.term[: t.first[1]].tolist(), w[: t.first[1]].tolist())) == pytest.approx({k: v / size for k, v in raw.items()})


def test_fit_is_sparse_and_agrees_with_a_coordinate_at_a_time():
    rng = np.random.default_rng(3)
    rows = [(c := int(rng.integers(3)), at := np.sort(np.append(rng.choice(20, 5, replace=False), 20 + rng.choice(20, 2, replace=False))), np.where(at < 20, 1.0 + 2 * (at % 3 == c), 0.1) / 5) for _ in range(400)]
    used, w, bias, temp = language_id.fitted(rows, 3, 60)
    assert 10 < len(used) < 30 and 0.02 <= temp <= 20
    every = np.zeros((60, 3))
    every[used] = w
    got = [int((every[r[1]].T @ r[2] + bias).argmax()) for r in rows]
    assert np.mean([g == r[0] for g, r in zip(got, rows)]) > 0.75
    a, b = language_id.Ftrl(5, 2), {}
    x, y = np.array([[0.5, 0.0, 1.0], [0.2, 0.7, 1.0]]), np.eye(2)[[0, 1]]
    for _ in range(30):
        a.learn(np.array([1, 3, 5]), x, y)
    for _ in range(30):
        def weight(j, k):
            z, n = b.get((j, k), (0.0, 0.0))
            l1, l2 = (0.0, 0.0) if j == 5 else (language_id.L1, language_id.L2)
            return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((language_id.BETA + math.sqrt(n)) / language_id.ALPHA + l2)

        now = {(j, k): weight(j, k) for j in (1, 3, 5) for k in (0, 1)}
        p = []
        for row in x:
            e = [math.exp(sum(v * now[j, k] for v, j in zip(row, (1, 3, 5)))) for k in (0, 1)]
            p.append([v / sum(e) for v in e])
        for c, j in enumerate((1, 3, 5)):
            for k in (0, 1):
                g = sum(x[r, c] * (p[r][k] - y[r, k]) for r in (0, 1))
                z, n = b.get((j, k), (0.0, 0.0))
                b[j, k] = z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / language_id.ALPHA * now[j, k], n + g * g
    assert a.weights(np.array([1, 3, 5])).ravel().tolist() == pytest.approx([weight(j, k) for j in (1, 3, 5) for k in (0, 1)], abs=1e-12)


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(5)
    z = rng.normal(0, 3, (500, 4))
    y = np.array([rng.choice(4, p=p) for p in language_id.softmax(z / 2.5)])
    assert language_id.temperature(z, y) == pytest.approx(2.5, rel=0.25)
    assert language_id.temperature(z[:0], y[:0]) == 1.0


def test_held_out_accuracy(spark):
    """On the larger table, whose held-out part has some thousands of texts."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = queries.op11_language_id(spark, "/root/testdata/sf0.01")
    rows = got.join(d, "doc_id").collect()
    assert len(rows) == d.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_awkward_rows(spark):
    rng = np.random.default_rng(1)
    word = {"x": "abcde", "y": "vwxyz"}
    say = lambda k, n: " ".join("".join(rng.choice(list(word[k]), 5)) for _ in range(n))
    rows = [(i, say(k := "xy"[i % 2], 20), k, 0) for i in range(120)]
    rows += [(200, None, "x", 1), (201, "", "y", 1), (202, "12 34 !?", "x", 1), (None, say("x", 5), "x", 1), (203, say("y", 60_000), None, 1), (1, rows[1][1], "y", 1), (1, rows[1][1], "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, id int").withColumn("lang_pred", F.lit("no")).withColumn("key", F.lit(3))
    got = language_id.identified(df).collect()
    assert len(got) == len(rows) and language_id.identified(df).exceptAll(language_id.identified(df.repartition(7))).isEmpty()
    by = {}
    for r in got:
        by.setdefault(r["id"], r)
    assert [by[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and by[200]["score"] == 0.0
    assert by[203]["lang_pred"] == "y" and by[None]["lang_pred"] == "x" and not by[None]["held_out"]
    held = [r for r in got if r["held_out"] and r["id"] < 120]
    assert len(held) > 10 and sum(r["lang_pred"] == "xy"[r["id"] % 2] for r in held) > 0.9 * len(held)
    assert {r["lang_pred"] for r in language_id.identified(df.where("false")).collect()} == set()
    assert {r["lang_pred"] for r in language_id.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r["lang_pred"] for r in language_id.identified(df.where("lang = 'x'")).collect()} == {"x", "und"}
    # languages of equal probability: the first by code point
    assert language_id.identified(spark.createDataFrame([(0, "ab", "b"), (0, "ab", "a")], "doc_id long, text string, lang string")).first()["lang_pred"] == "a"


def test_the_sample_is_bounded_and_frequencies_are_not(spark):
    rows = [(i, "word " * (i % 7 + 1) + "abc"[i % 3] * 9, "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, text string, lang string")
    whole, some = language_id.learned(df), language_id.learned(df, sample=30)
    assert np.array_equal(whole.idf, some.idf) and whole.langs == some.langs == ["a", "b", "c"]
