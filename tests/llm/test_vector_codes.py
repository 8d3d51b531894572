"""Vector code compression against plain Python integers on awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import common, vector_codes

rng = np.random.default_rng(4)
DIM = 8


def table():
    v = rng.normal(0, 0.2, (90, DIM)).astype(np.float32)
    v[40:60] = v[40]  # copies of one vector
    v[60:70, :2] = v[3, :2]  # of one part
    rows = [(int(i), [float(x) for x in v[k]], int(k % 3) if k % 7 else None) for k, i in enumerate(rng.permutation(90))]
    rows += [rows[0], rows[0], (rows[1][0], rows[2][1], 1), (None, rows[4][1], 2), (500, None, 1), (501, [0.0] * 7 + [None], 1), (502, [math.nan] + [0.0] * 7, 1)]
    return rows + [(503, [math.inf] * DIM, 1), (504, [], 1), (505, [1.0] * 4, 1), (506, [1.0] * 7, 1), (507, [100.0, -100.0] * 4, 5), (508, [-0.0, 1e-9, -1e-9, 0.5] * 2, 5)]


def brute(rows, parts=4, entries=16, rounds=4):
    f32 = lambda v: [float(np.float32(x)) for x in v]
    kept = [(i, f32(v), k) for i, v, k in rows if v is not None and len(v) == DIM and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    w = DIM // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    code = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [code(c[p], book) for c in cut]
            for k in set(of):
                own = [c[p] for c, g in zip(cut, of) if g == k]
                book[k] = tuple(sum(x) // len(own) for x in zip(*own))
    out, total = [], {}
    for (i, _, label), c in zip(kept, cut):
        codes = [code(c[p], books[p]) for p in range(parts)]
        error = sum(far(c[p], books[p][k]) for p, k in enumerate(codes))
        total[label] = total.get(label, 0) + error
        out.append((i, codes, error, label))
    return sorted(((*r, total[r[3]]) for r in out), key=repr), books


@pytest.mark.parametrize("entries", [16, 256])
def test_against_plain_integers(spark, entries):
    rows = table()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("pos", F.lit("x")).withColumn("row", F.lit(1)).withColumn("vec", F.lit(2)).withColumn("id", F.lit(3))
    want, books = brute(rows, entries=entries)
    got, own = vector_codes.compressed(df, entries=entries)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert own.tolist() == [[list(e) for e in b] for b in books]


def test_hot_parts_are_broadcast_and_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(table(), "vec_id long, embedding array<float>, label int")
    plain = sorted(vector_codes.compressed(df, entries=16)[0].collect(), key=repr)
    few = common.rejoined
    monkeypatch.setattr(vector_codes, "rejoined", lambda *a: few(*a, share=5))  # only parts of over a fifth
    assert sorted(vector_codes.compressed(df, entries=16)[0].collect(), key=repr) == plain


def test_large_components(spark):
    one = lambda v: spark.createDataFrame([(1, [v] * 4, 1), (2, [-v] * 4, 1), (3, [0.0] * 4, 1)], "vec_id long, embedding array<double>, label int")
    got, _ = vector_codes.compressed(one(50_000.0), entries=1)  # beyond two bytes
    x = [51_200_000, -51_200_000, 0]
    assert sorted(r["error"] for r in got.collect()) == sorted(4 * v * v for v in x)
    with pytest.raises(Exception, match="beyond 64 bits"):
        vector_codes.compressed(one(1e30))


def test_nothing_kept(spark):
    for rows in ([], [(1, None, 1), (2, [], None)]):
        got, books = vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert got.collect() == [] and books.size == 0
        assert got.columns == ["id", "codes", "error", "label", "label_error"]
