"""The filter audit against brute force on awkward rows."""

import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from fieldmark.llm import filter_audit

rng = random.Random(2)


def say(n, k=400):
    return " ".join(f"w{rng.randrange(k)}" for _ in range(n))


BASE = [say(rng.randrange(1, 250), rng.choice([5, 400, 4000])) for _ in range(40)]
LONG = say(9000, 10**6)
TEXTS = BASE + BASE[:10] + ["ABC def " + BASE[3], "$ " + BASE[4], None, None, "", "", " \t", "A" * 70, "A" * 69 + "B", LONG, LONG, LONG + "x", LONG[:-1] + "?", "é" * 64, "é" * 64, "é" * 63 + "e"]
TEXTS += [BASE[7]] * 200


def documents(spark):
    rows = [(i // 2 if i < 20 else i, t, rng.choice(["en", "de", None, ""]), 1) for i, t in enumerate(TEXTS)]
    rows += [(None, BASE[0], "en", 1), (None, BASE[0], "de", 1), rows[5], rows[5]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, n int").withColumn("mask", F.lit("m")).withColumn("id", F.lit(0)).withColumn("part", F.lit(9))


LABELS = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]


def failing(rows):
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *f in LABELS if i is not None and f[k] == 1} for k in (0, 1))
    for i, t, lang, _ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        yield lang or "", {k for k, v in f.items() if v}, i in good, i in toxic


def test_against_brute_force(spark):
    rows, df = documents(spark)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    counts = filter_audit.masks(df, labels)
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audited(counts, "ABCDE").collect()}
    each = list(failing(rows))
    first = Counter()
    want = {}
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in each}:
            own = [x[1:] for x in each if x[0] == part]
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [(g, x) for fails, g, x in own if f in fails and not fails & before]
                first[part, f] += len(here)
                want[part, "".join(order), k + 1] = [
                    sum(not fails & (before | {f}) for fails, _, _ in own), len(here), sum(f in fails and bool(fails & before) for fails, _, _ in own),
                    sum(fails == {f} for fails, _, _ in own), sum(g for g, _ in here), sum(x for _, x in here),
                ]
    assert got == {(p, o, k): (*v, first[p, o[k - 1]]) for (p, o, k), v in want.items()}
    assert len(got) == 3 * 120 * 5


def test_refinement_drops_singletons_block_by_block(spark):
    _, df = documents(spark)
    texts = df.select(F.coalesce("text", F.lit("")).alias("text"))
    live, upto = filter_audit.repeated(texts.select(F.length("text").alias("length"), filter_audit._blocks().alias("blocks"), "text").drop("mask"))
    seen = Counter(r["text"] for r in texts.collect())
    assert Counter(r["text"] for r in live.collect()) == {t: n for t, n in seen.items() if n > 1}
    assert upto == 4  # LONG ends in the fourth block


def test_texts_behind_equal_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "_blocks", lambda: F.array(*[F.lit(1).cast("long")] * len(filter_audit.ENDS)))
    rows, df = documents(spark)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = Counter()
    for r in filter_audit.masks(df, labels).collect():
        got[r["part"], frozenset(c for k, c in enumerate("ABCDE") if r["mask"] >> k & 1), r["good"], r["toxic"]] += r["n"]
    assert got == Counter((p, frozenset(f), g, x) for p, f, g, x in failing(rows))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(filter_audit.masks(docs, labels), "ABCDE").count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    got = filter_audit.audited(filter_audit.masks(one, labels), "ABCDE").where("step = 1 and filter_order = 'ABCDE'").first()
    assert tuple(got) == ("", "ABCDE", 1, 0, 1, 0, 1, 0, 0, 120)
