"""Each operator against a brute-force version on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmark.llm import ann, bpe, graph, html_extract, lm_score, minhash, mixing, pii, quality, substring_dedup, url_filter
from fieldmark.llm.common import stored
from fieldmark.llm.words import windows as windows_of
from fieldmark.llm.words import words as words_of

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
rng = random.Random(5)
VOCAB = ["ab", "Cd", "é", "x1", "日本", "the", "THE", "of", "zz", "q"] + [f"w{i}" for i in range(200)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


PASSAGE = prose(60)
LONG = prose(9000)


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(rng.randint(1, 200)) for _ in range(60)]
    near = [" ".join(w if k % 37 else "changed" for k, w in enumerate(base[0].split() * 3)) for _ in range(3)]
    texts = base + [base[3]] * 4 + [base[0] + " " + base[0] + " " + base[0], *near, "A B " + PASSAGE + " c", PASSAGE + "\n" + PASSAGE, LONG, LONG + " tail"]
    texts += ["", " \t\n", "one", "Two words", "two  WORDS", "a\x0bb\x0cc\rd", None, None, "line one two\nline one two\n\n \nline one two", "# $ % & | < > x\n#"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), 7) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id at all here", "en", "s1", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long").cache()


def words(t):
    return (t or "").encode().split()


def rows_of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_substring_dedup(docs):
    all_rows = rows_of(docs, "doc_id", "text")
    seen = Counter(tuple(w[i : i + 35]) for _, t in all_rows for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for i, t in all_rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    got = rows_of(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 18_000


def shingles(t, size):
    w = words((t or "").encode().translate(LOWER).decode())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, size, percent):
    all_rows = rows_of(docs, "doc_id", "text")
    sets = [shingles(t, size) for _, t in all_rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            inner = len(sets[i] & sets[j])
            if inner and 100 * inner >= percent * (len(sets[i]) + len(sets[j]) - inner):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(all_rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = [(i, len(s), least.get(find(k)), i == least.get(find(k))) for k, ((i, _), s) in enumerate(zip(all_rows, sets))]
    got = rows_of(minhash.near_duplicates(docs, size=size, percent=percent), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_duplicates_in_a_large_split_group(spark):
    """A hub with spokes around the threshold, so that large groups hold several components."""
    r = random.Random(9)
    hub = [f"h{i}" for i in range(300)]
    texts = [" ".join(hub)]
    for k in range(60):
        w = list(hub)
        for _ in range(r.randint(4, 14)):
            w[r.randrange(300)] = f"k{k}x{r.random()}"
        texts.append(" ".join(w))
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 3) for t in texts]
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    comp = list(range(len(sets)))
    for _ in comp:
        for i, j in edges:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert dict(rows_of(minhash.near_duplicates(df), "doc_id", "component_id")) == dict(enumerate(comp))


def test_sketch_estimates():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    b = np.concatenate([a[:2400], r.integers(0, 1 << 64, 600, dtype=np.uint64)])
    est, used = minhash.estimate(minhash.sketch(np.unique(a), 160)[None], minhash.sketch(np.unique(b), 160)[None], np.array([3000]), np.array([3000]))
    assert used[0] == 160 and est[0] == pytest.approx(2400 / 3600, abs=0.15)
    assert minhash.plan(0.85) == (6, 26) and minhash.plan(0.8) == (5, 32)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (6, 6), (None, 1), (5, 10)], "a long, b long")
    assert dict(rows_of(graph.components(e), "node", "comp")) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 1, 7: 7, 8: 7, 9: 7}
    assert graph.components(e.limit(0)).count() == 0


def test_quality_measures(docs):
    want = []
    for i, t in rows_of(docs, "doc_id", "text"):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        flag = [0] * len(w)
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                flag[k : k + 8] = [1] * 8
        want.append((i, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), sum(flag)))
    got = rows_of(quality.measured(docs), "doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words")
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_quality_verdicts(spark):
    clean = [(i, prose(rng.randint(30, 120)), "en", f"s{i % 2}") for i in range(500)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(60).split()), "en", "s0") for i in range(20)]
    got = {r["doc_id"]: r["_kept"] for r in quality.judged(stored(quality.measured(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")), "q")).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)


@pytest.mark.parametrize("rate", list(quality.RATES))
def test_quality_fences_beyond_the_base_rule(spark, rate):
    """Each rate rejects a document that the base rule keeps, and no ordinary one."""
    r = random.Random(7)
    plain = [(i, "\n".join(" ".join(r.choice(VOCAB) for _ in range(12)) for _ in range(10))) for i in range(300)]
    odd = {
        "symbols": " ".join(f"w{k}" + "#" * (k % 4 == 0) for k in range(120)),
        "word_length": " ".join("x" * 20 + str(k) for k in range(120)),
        "dup_lines": "\n".join("one and the same" if k % 3 == 0 else " ".join(f"u{k}x{j}" for j in range(8)) for k in range(12)),
        "repeats": " ".join(f"v{k}" for k in range(160)) + " " + " ".join(f"v{k}" for k in range(20)),
    }[rate]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in [*plain, (999, odd)]], "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: (x["_base_failed"], x["_kept"]) for x in quality.judged(stored(quality.measured(df), "q")).collect()}
    assert got.pop(999) == (False, False) and set(got.values()) == {(False, True)}


def test_mixing(docs):
    m = mixing.mix(docs, keep=["doc_id", "source"]).select("doc_id", "source", "_mix.*").collect()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in m:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    keys = sorted((k for k in size if k is not None)) + [None]
    weight, left, free, want = dict(zip(keys, (5, 2, 1) * 3)), sum(size.values()), set(keys), {}
    while over := [k for k in free if left * weight[k] / sum(weight[x] for x in free) > 3 * size[k] + 1e-9]:
        for k in over:
            want[k] = 3 * size[k]
        free -= set(over)
        left = sum(size.values()) - sum(want.values())
    for k in free:
        want[k] = left * weight[k] / sum(weight[x] for x in free)
    assert target == pytest.approx(want) and sum(target.values()) == pytest.approx(sum(size.values()))
    largest = max(r["size"] for r in m)
    assert all(abs(taken[k] - target[k]) <= largest for k in keys)
    again = mixing.mix(docs, keep=["doc_id", "source"]).select("doc_id", "source", "_mix.*").collect()
    assert sorted(map(repr, m)) == sorted(map(repr, again))


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
    return True


def test_pii_base_spans(spark):
    r = random.Random(8)
    pieces = ["a@b.c", "_x@y", ".", "@", "+1 (555) 123-4567", "+", "1.2.3.4", ".5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111111111111111", "-", " ", "9", "é日", "\n", "b.c.d@e-f.g.h", "00012.1.1.1", "5500005555555559"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(1500)] + [None, "", "9" * 9000, "a" * 9000 + "@b.cd", "1.1.1.1 " * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = dict(rows_of(pii.sanitised(df), "doc_id", "_spans"))
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        assert [(s["kind"], s["at"], s["to"]) for s in got[i] if s["kind"] != "term"] == want, t


def brute_terms(texts):
    """Terms over the disclosure threshold, counted by document."""
    words_, ents = [], []
    for t in texts:
        words_.append(set(re.findall(pii.WORD, (t or "").lower())))
        hits = [(k, m.group()) for k, p in PII.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        ents.append({(k, re.sub("[^0-9]", "", h) if k in ("card", "phone") else h.lower()) for k, h in hits})
    n, out = len(texts), set()
    n_t, n_e = Counter(w for ws in words_ for w in ws), Counter(e for es in ents for e in es)
    n_te, support = Counter(), defaultdict(set)
    for t, ws, es in zip(texts, words_, ents):
        for w in ws:
            for e in es:
                n_te[w, e] += 1
                support[w, e].add(t)
    for (w, e), c in n_te.items():
        if len(support[w, e]) >= pii.SUPPORT and c / n_t[w] >= pii.SHARE and math.log2(c / n_t[w] / (n_e[e] / n)) >= pii.BITS_OVER:
            out.add(w)
    return out


@pytest.mark.parametrize("doubled", [False, True])
def test_pii_revealing_terms(spark, doubled):
    rows = [(i, f"Note {i} from Quartermain reach q@x.org now and text number {i * 7}") for i in range(6)]
    rows += [(20 + i, f"far Ostrander {'y' * 150}{i} a b c d e f g h {' ' * 150} +1 (555) 123-4567 z{i % 2}") for i in range(4)] + [(30, "note that Ostrander has no number here")]
    rows += [(40 + i, "the same text 1.2.3.4 again and Samesake") for i in range(5)]
    rows += [(100 + i, f"reach me now and then from here text number {i} a b c d e f g h") for i in range(90)] + [(300, None), (301, "")]
    rows = rows + rows if doubled else rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_terms([t for _, t in rows])
    assert {"quartermain", "far"} <= want and not {"reach", "samesake", "ostrander", "a"} & want
    out = pii.sanitised(df)
    got = {(r["doc_id"], s["hit"], s["at"], s["to"]) for r in out.collect() for s in r["_spans"] if s["kind"] == "term"}
    base = {i: [(m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, t or "") if valid(k, m.group())] for i, t in rows}
    assert got == {(i, m.group().lower(), m.start(), m.end()) for i, t in rows for m in re.finditer(pii.WORD, t or "") if m.group().lower() in want and not any(x < m.end() and m.start() < y for x, y in base[i])}
    texts = dict(rows_of(pii.redacted(out), "doc_id", "text"))
    assert texts[3] == "Note 3 from [TERM] reach [EMAIL] now and text number 21" and texts[101] == "reach me now and then from here text number 1 a b c d e f g h" and texts[300] is None and texts[301] == ""


def test_pii_redacts_overlaps_and_many_spans_in_time(spark):
    import time

    many = " ".join(f"u{i}@x{i}.org {i}" for i in range(20_000))
    df = spark.createDataFrame([(1, "call 4111 1111 1111 1111 now"), (2, many), (3, "a@b.c1.2.3.4")], "doc_id long, text string")
    began = time.time()
    got = dict(rows_of(pii.redacted(pii.sanitised(df)), "doc_id", "text"))
    assert got[2].split(" ") == [x for i in range(20_000) for x in ("[EMAIL]", str(i))] and time.time() - began < 120
    assert got[1] == "call [CARD] now" and got[3] == "[EMAIL]"


def brute_kept(rows):
    """Verdicts from log-cell quantiles per language and source, drawn towards the language's and the corpus'."""
    step, rates = math.log(1.01 / 0.99), {}
    for i, t, lang, source in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        flag = [0] * len(w)
        for k in range(len(w) - 7):
            if c[tuple(w[k : k + 8])] > 1:
                flag[k : k + 8] = [1] * 8
        rates[i] = (lang, source, len(w), sum(flag), [sum(ch in "#*$%&|<>" for ch in t or "") / max(len(w), 1), sum(map(len, w)) / max(len(w), 1), (len(lines) - len(set(lines))) / max(len(lines), 1), sum(flag) / max(len(w), 1)])
    cells = lambda ok, k: sorted(0.0 if x[4][k] == 0 else math.exp(math.ceil(math.log(x[4][k]) / step) * step) * 0.99 for x in rates.values() if x[2] and ok(x))
    out = {}
    for i, x in rates.items():
        bad = x[2] < 20 or 100 * x[3] > 30 * x[2]
        for k, (slack, lower) in enumerate([(0.1, 0), (2.0, 1), (0.2, 0), (0.1, 0)]):
            if not x[2]:
                continue
            own, lang, every = cells(lambda y: y[:2] == x[:2], k), cells(lambda y: y[0] == x[0], k), cells(lambda y: True, k)
            at = lambda v, q: v[-(-len(v) * q // 100) - 1]
            mixed = [(len(own) * at(own, q) + 50 * (len(lang) * at(lang, q) + 50 * at(every, q)) / (len(lang) + 50)) / (len(own) + 50) for q in (10, 50, 90)]
            bad |= x[4][k] > mixed[2] + 3 * (mixed[2] - mixed[1]) + slack or (lower and x[4][k] < mixed[0] - 3 * (mixed[1] - mixed[0]) - slack)
        out[i] = not bad
    return out


def test_quality_kept_by_brute_force(spark):
    r = random.Random(17)
    rows = []
    for i in range(260):
        w = [r.choice(VOCAB) + "#" * (r.random() < r.choice([0, 0, 0.05, 0.4])) for _ in range(r.randint(0, 90))]
        w = [x * r.choice([1, 1, 1, 4]) if i % 9 == 0 else x for x in w]
        t = "\n".join(" ".join(w[k : k + 10]) for k in range(0, len(w), 10)) + ("\nsame line here" * (i % 6 if i % 5 == 0 else 0))
        rows.append((i, t if i % 50 else None, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = brute_kept(rows)
    for parts in (1, 7):
        got = dict(rows_of(quality.judged(stored(quality.measured(df.repartition(parts)), "q")), "doc_id", "_kept"))
        assert got == want and 0 < sum(want.values()) < 240


def test_lm_score(docs):
    all_rows = rows_of(docs, "doc_id", "text")
    tokens = [((t or "").encode().translate(LOWER).split()) + [None] for _, t in all_rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in all_rows]
    c = Counter(t for w, h in zip(tokens, held) if not h for t in w)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, h, len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w), 6)) for (i, _), h, w in zip(all_rows, held, tokens)), key=repr)
    out = lm_score.score(docs, rounds=4).cache()
    got = rows_of(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6))
    assert sorted(got, key=repr) == want
    assert out.where("score >= 0 or isnan(score)").count() == 0


def test_lm_learns_order(spark):
    """Alternating words are predictable from the previous one, which the base can't see."""
    rows = [(i, " ".join(["a b", "c d"][rng.random() < 0.5] for _ in range(40))) for i in range(200)]
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out")
    base, full, n = out.agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert full / n > base / n + 0.2


def test_lm_class_probabilities_sum_to_one():
    w = np.random.default_rng(0).normal(size=(lm_score.FEATURES, lm_score.CLASSES))
    assert np.exp(lm_score._log_softmax(w, np.arange(50))).sum(axis=1) == pytest.approx(np.ones(50))


def test_bpe(spark, docs, monkeypatch):
    monkeypatch.setattr(bpe, "PACK_BYTES", 20_000)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 500)
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {(r["doc_id"], bytes(r["decoded"])): r["ids"] for r in bpe.encode_decode(docs, path, tokenizers.PATTERN).collect()}
    for i, t in rows_of(docs, "doc_id", "text"):
        assert got[i, (t or "").encode()] == ref.encode_ordinary(t or "")
    r = random.Random(4)
    odd = ["".join(r.choice("aab  bcd\n\té日🙂'sS1239.,!-") for _ in range(r.randint(0, 300))) for _ in range(300)] + ["a" * 3000, "<|endoftext|>", " " * 999 + "x"]
    own = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert dict(rows_of(bpe.encode_decode(own, path, tokenizers.PATTERN), "doc_id", "ids")) == {i: ref.encode_ordinary(t) for i, t in enumerate(odd)}
    clash = own.withColumns({c: F.lit("x") for c in ("unit", "body", "size", "__text", "ids", "bucket")})
    assert bpe.encode_decode(clash, path, tokenizers.PATTERN).count() == len(odd) and bpe.encode_decode(own.limit(0), path, tokenizers.PATTERN).count() == 0
    digests = {r["doc_id"]: r for r in bpe.encode_decode(docs.where("doc_id = 5"), path, tokenizers.PATTERN, digests=True).collect()}
    ids = ref.encode_ordinary(docs.where("doc_id = 5").first()["text"])
    assert digests[5]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_ann(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(900, 16))
    x[300:500] = x[300]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [rows[10], (901, None), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1.0] * 3), (None, rows[3][1])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=50).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 50):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(900), -s))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        hit += len(set(want) & set(mine.vec_id))
    assert hit / (18 * 5) >= 0.9 and set(got.query_id) == set(range(0, 900, 50))
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), k=5).toPandas()
    assert sorted(few.vec_id) == [1, 2]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies on this site to serve you better.</div>
<div id=content><div class="post-body"><h2>A  tale</h2>Some <b>bo</b>ld &amp; text,
 long enough &lt;to be&gt; read.<p>Second para with many words in it<br>so it reads like text.<blockquote>Quoted words of some length stand here.</blockquote></div>
<div class="comments"><p>I loved this article so very much, thank you for writing it.</p></div></div>
<aside>Related stories you may like to read today.</aside><form>Name <input name=x> Send me the newsletter every day.</form><footer>&copy; 2024 All rights</footer>"""


def test_html(spark):
    want = "A tale\nSome bold & text, long enough <to be> read.\nSecond para with many words in it so it reads like text.\nQuoted words of some length stand here."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p><b"), (5, "u", "<article><p>cut off &am"), (None, "u", PAGE), (6, "u", "<article>" + "<p>word word word.</p>" * 3000 + "</article>")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == got[None]["text"] == want and got[1]["n_chars"] == len(want)
    assert [got[i]["text"] for i in (2, 3, 4, 5)] == ["", "", "", "cut off &am"] and got[6]["text"].count("\n") == 2999


def test_min_cut_is_minimal():
    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 8)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 1.5)) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda lab: sum(abs(o) for o, x in zip(odds, lab) if (o > 0) != x and o) + sum(w for a, b, w in edges if lab[a] != lab[b])
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_extract.min_cut(odds, edges)) == pytest.approx(best)


def test_url_filter(spark):
    caps = [(1, "https://a.b.com/x", "2024-02-01"), (2, "http://b.com.", "2024-01-01"), (3, "http://user@A.B.com:80/", "2024-03-05"), (4, None, "2024-02-01"), (5, "nonsense", "2024-02-01"), (6, "http://b.com/", None), (7, "http://zb.com/", "2024-02-01"), (1, "https://a.b.com/x", "2024-02-01"), (8, "http://[2001:DB8::1]:80/x", "2024-02-01"), (9, "http://1.2.3.4/", "2024-02-01"), (10, "http://u@v@5.6.7.8:9", "2024-02-01"), (11, "http://d.com", "2024-02-01")]
    lists = [("3.4", "block", "2024-01-01"), ("[2001:db8::1]", "block", "2024-01-01"), ("5.6.7.8", "block", "2024-01-01"), ("d.com", "block", "2024-01-01"), ("d.com", "watch", "2024-01-01"), ("b.com", "block", "2024-01-15"), ("b.com", "allow", "2024-03-01"), ("a.b.com", "block", "2024-03-05"), ("a.b.com", "allow", "2024-03-05"), (None, "block", "2024-01-01"), ("c.com", None, None)]
    c = spark.createDataFrame(caps, "page_id long, url string, d string").withColumn("fetched_at", F.to_date("d")).withColumn("host", F.lit("clash"))
    e = spark.createDataFrame(lists, "domain string, action string, d string").select("domain", "action", F.to_date("d").alias("listed_at"))
    out = url_filter.judged(c, e)
    got = {r[0]: (r[1], r[2]) for r in rows_of(out, "page_id", "_verdict.matched", "_verdict.kept")}
    assert got == {1: ("b.com", False), 2: (None, True), 3: ("a.b.com", False), 4: (None, True), 5: (None, True), 6: (None, True), 7: (None, True), 8: ("[2001:db8::1]", False), 9: (None, True), 10: ("5.6.7.8", False), 11: ("d.com", False)}
    assert out.count() == len(caps) and "host" in out.columns and url_filter.judged(c.limit(0), e).count() == 0 and url_filter.judged(c, e.limit(0)).where("not _verdict.kept").count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert quality.judged(quality.measured(none)).count() == 0
    assert mixing.mix(none).count() == 0
    assert pii.redacted(pii.sanitised(none)).count() == 0
    assert lm_score.score(none, rounds=1).count() == 0


def test_clashing_columns(docs):
    wide = docs.select("*", *[F.lit(1).alias(c) for c in ("unit", "key", "id", "size", "hash", "rank", "h", "c", "band", "kind", "source_size", "n_words", "rep", "_extra")])
    assert substring_dedup.remove_repeats(wide).count() == docs.count()
    assert minhash.near_duplicates(wide).count() == docs.count()
    assert quality.judged(quality.measured(wide)).count() == docs.count()
    assert mixing.mix(wide).count() == docs.count()
    assert pii.sanitised(wide).count() == docs.count()
    assert lm_score.score(wide, rounds=1).count() == docs.count()


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    d = docs.withColumnRenamed("n", "n_chars")
    kept = cp.quality_rules(spark, d, "")
    assert kept.columns == d.columns and kept.where("text is null").count() == 0
    near = cp.near_duplicates(spark, d, "")
    ids = Counter(r[0] for r in rows_of(near, "doc_id"))
    comps = minhash.near_duplicates(d, size=5, percent=80)
    with_words = comps.where("n_shingles > 0")
    assert near.columns == d.columns and near.where("text is not null").join(with_words.select("doc_id"), "doc_id", "left_semi").count() == with_words.select("component_id").distinct().where("component_id is not null").count()
    assert ids[5] == 1 if 5 in ids else True
    clean = cp.personal_data(spark, d, "")
    assert clean.columns == d.columns and clean.count() == d.count()
    mixed = cp.mix_sources(spark, d, "")
    assert mixed.columns == d.columns
    t = cp.tokens(spark, d, "")
    assert t.where("not round_trip").count() == 0 and t.count() == d.count()


def _thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_that_collide_modulo_powers_of_two(spark):
    """Sequences that any polynomial modulo 2^64 takes for equal, as words and as sequences of words."""
    one, two = _thue_morse(1024), _thue_morse(1024, True)
    tail = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(1, one), (2, two), (3, one + " " + tail), (4, two + " " + tail)], "doc_id long, text string")
    assert sorted(rows_of(minhash.near_duplicates(df), "component_id")) == [(1,), (2,), (3,), (3,)]
    cut = spark.createDataFrame([(3, f"{one} " + " ".join(tail.split()[:34])), (4, f"{two} " + " ".join(tail.split()[:34]))], "doc_id long, text string")
    assert rows_of(substring_dedup.remove_repeats(cut).groupBy().sum("n_removed"), "sum(n_removed)") == [(0,)]
    spread = [" ".join(_thue_morse(2048, k)) for k in (False, True)]
    assert len(set(lm_words(x) for x in spread)) == 2


def lm_words(text):
    w = words_of(pa.array([text]), wide=True)
    return (windows_of(w.hash, w.first, 2048)[0][0], windows_of(w.wide, w.first, 2048)[0][0])


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ann, "CELL", 900)
    monkeypatch.setattr(ann, "CODE_BLOCK", 1500)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)


def _recall(spark, x, k=5, every=50):
    got = ann.nearest(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>"), k=k, every=every).toPandas()
    unit, hit, all_ = x / np.linalg.norm(x, axis=1, keepdims=True), 0, 0
    for q in range(0, len(x), every):
        s = unit @ unit[q]
        s[q] = -9
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == k and mine["score"].to_numpy() == pytest.approx(s[mine["vec_id"].to_numpy()], abs=1e-12)
        hit += (np.round(mine["score"].to_numpy(), 12) >= np.round(np.sort(s)[-k], 12)).sum()
        all_ += k
    return hit / all_


def test_ann_recall_on_clusters_and_skewed_norms(spark, small_blocks):
    """Over 10,000 vectors in several cells, blocks and query blocks: strangers, loose, close and very close clusters."""
    r = np.random.default_rng(2)
    x = [r.normal(size=(4000, 32))]
    for spread, n in ((0.1, 2000), (0.01, 2000), (0.001, 2500)):
        x += [r.normal(size=32) + spread * r.normal(size=(n // 2, 32)) for _ in range(2)]
    x = np.concatenate(x) * np.exp(2 * r.normal(size=(10500, 1)))
    assert _recall(spark, x[r.permutation(len(x))]) >= 0.95


def test_ann_ties_are_all_scored(spark):
    """Over 200 multiples of few directions: equal codes, of which the least ids must come out."""
    r = np.random.default_rng(4)
    way = r.normal(size=(3, 8))
    rows = [(i, (2.0 ** (i % 50) * way[i % 3]).tolist()) for i in range(1200)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=100).toPandas()
    for q in range(0, 1200, 100):
        want = [i for i in range(q % 3, 40, 3) if i != q][:5]
        assert sorted(got[got.query_id == q]["vec_id"]) == want


def test_ann_extreme_sizes_and_clashing_columns(spark):
    rows = [(i, [s * v for v in ([1.0, 2.0, 3.0] if i % 2 else [3.0, -1.0, 0.5])]) for i, s in enumerate([1e200, 1e-200, 1e-300, 1e300, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "c", "q", "cell", "rank", "score", "ids")})
    got = ann.nearest(df, k=2, every=2).toPandas()
    assert not got["score"].isna().any() and sorted(got[got.query_id == 0]["vec_id"]) == [2, 4] and got["score"].min() == pytest.approx(1)


def _page(name, extra=""):
    para = "<p>" + "Plain words of a paragraph that goes on for a while, as they do. " * 3 + "</p>"
    return f'<body><nav><a href=x>Home</a> <a href=y>News</a></nav><div class="{name}">{para}{extra}{para}</div><div class="comments"><h3>Comments</h3>{para}{para}</div><footer>{para}</footer></body>', para


@pytest.mark.parametrize("name", ["post-body no-sidebar", "content has-comments", "entry tags-travel", "article-share-wrapper", "plain", "pageWithSidebar"])
def test_html_names_are_weighed(name):
    page, para = _page(name)
    assert html_extract.main_text(page).split("\n") == [para[3:-4].strip()] * 2


def test_html_cut_changes_labels():
    """A line that looks like boilerplate on its own stays between paragraphs, and a lone one goes."""
    page, para = _page("plain", "<p>Indeed</p>")
    assert [(z > 0, keep) for t, z, keep in html_extract.labelled(page) if t == "Indeed"] == [(False, True)]
    assert html_extract.main_text(page).split("\n")[1] == "Indeed"


def test_html_generated_pages():
    """Main text known from the making: blocks in random wrappers, with boilerplate around and inside."""
    r = random.Random(12)
    say = lambda n: " ".join(r.choice(VOCAB) for _ in range(n)) + "."
    for _ in range(60):
        paras = [say(r.randint(12, 80)) for _ in range(r.randint(1, 12))]
        inside = r.choice(["", f"<aside>{say(30)}</aside>", f'<div class="advert">{say(20)}</div>', f"<script>{say(9)}</script>", f'<div class="newsletter-signup"><p>{say(15)}</p></div>'])
        body = "".join(f"<p>{p}</p>" + (inside if k == 0 else "") for k, p in enumerate(paras))
        tag, name = r.choice([("article", "post"), ("main", ""), ("div", "entry-content"), ("div", "article-body"), ("section", "story no-ads")])
        comments = "".join(f'<article class="comment-body"><p>{say(40)}</p></article>' for _ in range(r.randint(0, 9)))
        page = f'<html><head><title>{say(4)}</title></head><body class="has-sidebar"><div id="cookie-notice"><p>{say(18)}</p></div><header><ul>' + "".join(f"<li><a href=/>{say(2)}</a></li>" for _ in range(8))
        page += f'</ul></header><div class="layout-with-sidebar"><{tag} class="{name}">{body}</{tag}><div class="sidebar-left"><p>{say(30)}</p></div></div><section id="comments">{comments}</section><footer><p>{say(25)}</p></footer></body></html>'
        assert html_extract.main_text(page) == "\n".join(paras), page


def test_html_large_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 40_000 + "</section>" * 40_000 + "x", "<div><p>some short</p></div>" * 40_000, "<p>a<div>" + "<center>" * 20_000 + "<p>b</p>" * 20_000):
        html_extract.main_text(page)
    assert time.time() - began < 60


def test_html_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "a", "b", 3)], "page_id long, url string, html string, text string, __html string, n_chars int")
    assert html_extract.extract(df).count() == 1 and html_extract.extract(df.limit(0)).count() == 0


def test_lm_word_weights_by_brute_force():
    """Softmaxes of each history against plain loops, and their sum."""
    r = np.random.default_rng(8)
    past = np.sort(r.integers(0, 30, 400))
    pair = np.unique(past * 10_000 + r.integers(0, 300, 400))
    past, word = pair // 10_000, pair % 10_000
    past = np.unique(past, return_inverse=True)[1]
    count = r.integers(0, 6, len(pair))
    other, own = lm_score.learn(past, word, count, rounds=7)
    for f in range(past.max() + 1):
        n = {int(w): int(c) for p, w, c in zip(past, word, count) if p == f}
        known = {w: c for w, c in n.items() if c >= lm_score.LEAST}
        classes = defaultdict(dict)
        for w, c in known.items():
            classes[w % lm_score.GROUPS][w] = c
        lam, kap = dict.fromkeys(known, 0.0), dict.fromkeys(classes, 0.0)
        for _ in range(7):
            z = 1 + sum(math.exp(k) for k in kap.values())
            new = {}
            for g, ws in classes.items():
                zw = sum(math.exp(lam[w]) for w in ws)
                total = sum(ws.values())
                for w, c in ws.items():
                    p = math.exp(lam[w]) / zw
                    new[w] = lam[w] + (c - total * p - lam[w] / lm_score.PRIOR) / (total * p * (1 - p) + 1 / lm_score.PRIOR + 0.25)
                p = math.exp(kap[g]) / z
                kap[g] = kap[g] + (total - sum(n.values()) * p - kap[g] / lm_score.PRIOR) / (sum(n.values()) * p * (1 - p) + 1 / lm_score.PRIOR + 0.25)
            lam = new
        z = 1 + sum(math.exp(k) for k in kap.values())
        want = {w: math.exp(lam[w]) / sum(math.exp(lam[v]) for v in ws) * math.exp(kap[g]) / z for g, ws in classes.items() for w in ws}
        got = {int(w): float(x) for p, w, x in zip(past, word, own) if p == f}
        assert got == pytest.approx({w: want.get(w, 0.0) for w in n}) and other[f] == pytest.approx(1 / z)
        assert other[f] + sum(got.values()) == pytest.approx(1.0)


def test_lm_tells_repeated_texts_apart(spark):
    """Texts that stand twice in the training part score above texts like them that stand once; so does a held-out copy."""
    r = random.Random(21)
    vocab = [f"v{k}" for k in range(400)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    texts = [" ".join(r.choice(vocab) for _ in range(60)) for _ in range(120)]
    rows, ids = [], iter(range(10_000))
    train, test = (lambda: next(i for i in ids if not held(i))), (lambda: next(i for i in ids if held(i)))
    twice, once, copied, fresh = [], [], [], []
    for k, t in enumerate(texts):
        if k < 30:
            twice += [train(), train()]
            rows += [(twice[-1], t), (twice[-2], t)]
        elif k < 60:
            once.append(train())
            rows.append((once[-1], t))
        elif k < 90:
            copied.append(test())
            rows += [(copied[-1], t), (train(), t), (train(), t)]
        else:
            fresh.append(test())
            rows.append((fresh[-1], t))
    got = {x["doc_id"]: x["score"] / x["n_tokens"] for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in twice) > max(got[i] for i in once) and min(got[i] for i in copied) > max(got[i] for i in fresh)


def test_short_texts_with_a_common_shingle(spark):
    """Many short texts agree on a band by their one common shingle, and link only where they should."""
    r = random.Random(31)
    texts = [f"all rights reserved {' '.join(f'x{r.randrange(60)}' for _ in range(k % 4))}".strip() for k in range(300)]
    texts += [f"all rights reserved {' '.join(f'y{j}' for j in range(20))} {k % 3}" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 3) for t in texts]
    comp = list(range(len(sets)))
    for _ in range(8):
        for i in range(len(sets)):
            for j in range(i):
                if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert dict(rows_of(minhash.near_duplicates(df), "doc_id", "component_id")) == dict(enumerate(comp))


def test_records_of_one_template(spark):
    """3,000 texts with one changed number share most shingles and link with none; bounds tell, not pairs."""
    word = [f"word{i}" for i in range(23)]
    rows = [(i, " ".join(word[:10] + [f"number{i}"] + word[11:])) for i in range(3000)]
    rows += [(5000 + i, " ".join(f"long{k}" if k != 300 else f"change{i}" for k in range(400))) for i in range(40)]  # these do
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).select("doc_id", "component_id").collect()
    assert all(r["component_id"] == min(r["doc_id"], 5000) for r in got) and len(got) == 3040


def test_residual_groups_in_small_blocks(spark, monkeypatch):
    """Groups that heads leave in several components, cut into blocks of a few rows and shingles."""
    r = random.Random(9)
    texts = []
    for g in range(12):
        shared = [f"g{g % 3}w{i}" for i in range(120)]
        own = shared[:90] + [f"own{g}x{i}" for i in range(40)]
        texts += [" ".join(w if r.random() > 0.012 else f"e{r.random()}" for w in own) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t, 3) for t in texts]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    for rows_a_block, items in ((512, 1 << 21), (4, 1 << 21), (512, 300)):
        monkeypatch.setattr(minhash, "BLOCK", rows_a_block)
        monkeypatch.setattr(minhash, "BLOCK_ITEMS", items)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).select("doc_id", "component_id").collect()}
        assert got == {i: find(i) for i in range(len(rows))}


def test_copies_of_a_text_are_encoded_in_many_units(spark):
    """10^5 equal texts: none of the units that hold them stands out."""
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    text = prose(12)
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    got = bpe.encode_decode(df, path, tokenizers.PATTERN, digests=True)
    assert got.count() == 100_000 and got.select("n_tokens", "ids_sha256", "decoded_sha256").distinct().collect()[0]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    plan = got._jdf.queryExecution().toString()
    units = df.groupBy(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16))).count().toPandas()["count"]
    assert "xxhash64(doc_id" in plan and units.max() < 1.1 * 100_000 / 16


CLASHING = [
    "m", "row", "_n", "_h", "_w", "_s", "_p", "_q", "_lines", "_dense", "_symbols", "_cut", "_lang", "_source", "_base", "_row", "_terms", "_email", "_spans", "_m", "_src", "_mix",
    "_host", "_at", "_d", "own", "day", "host", "at", "_verdict", "_none", "_id", "_key", "_nth", "nth", "key", "id", "part", "set", "n", "c", "__unit", "__text",
]


@pytest.fixture(scope="module")
def named(docs):
    """The documents with a column of every helper's name, which tells its row."""
    few = docs.where("doc_id < 60").drop("n").withColumn("n_chars", F.length("text")).withColumn("tag", F.col("doc_id"))
    for c in CLASHING:
        few = few.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    return stored(few, "named")


def unhurt(out, without=()):
    kept = [c for c in CLASHING if c not in without]
    assert set(kept) <= set(out.columns) and len(out.columns) == len(set(out.columns))
    rows = out.select("tag", *kept).collect()
    assert rows and all(r[c] == f"{c}{r['tag']}" for r in rows for c in kept)


def test_helper_names_clash_with_no_column(named):
    unhurt(quality.judged(stored(quality.measured(named), "measured")), ("_q",))
    unhurt(pii.sanitised(named), ("_spans",))
    unhurt(mixing.mix(named), ("_mix",))
    captures = named.withColumn("url", F.lit("http://a.example.org/x")).withColumn("fetched_at", F.to_date(F.lit("2024-02-01")))
    entries = captures.limit(1).select(F.lit("example.org").alias("domain"), F.lit("block").alias("action"), F.to_date(F.lit("2024-01-01")).alias("listed_at"))
    got = url_filter.judged(captures, entries)
    unhurt(got, ("_verdict",))
    assert {r["_verdict"]["matched"] for r in got.collect()} == {"example.org"}


def test_pipeline_stages_keep_clashing_columns(spark, named):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, "")
        assert out.columns == named.columns, name
        unhurt(out)


def test_other_operators_ignore_clashing_columns(spark, named):
    assert minhash.near_duplicates(named).count() == named.count() == substring_dedup.remove_repeats(named).count() == lm_score.score(named).count()


PARAGRAPHS = [
    "The river rose for three days before anyone in the valley thought of moving the cattle to higher ground.",
    "By the time the bridge went, most of the families had already spent two nights in the old school on the hill.",
]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WHOLE = "\n".join(PARAGRAPHS)
PAGES = {
    "no end of head": f"<html><head><title>T</title><meta charset=utf-8><body><article>{BODY}</article></body></html>",
    "neither end of head nor body": f"<html><head><title>T</title><script>var a;</script><article>{BODY}</article></html>",
    "neither, and a div": f"<head><title>T</title><div>{BODY}</div>",
    "text ends a head": f"<head><title>T</title>{PARAGRAPHS[0]}<p>{PARAGRAPHS[1]}</p>",
    "open select": f"<body><div><select><option>One<option>Two</div><article>{BODY}</article>",
    "open select, same element": f"<body><select><option>One<option>Two<article>{BODY}</article>",
    "open button": f"<body><button>Menu<article>{BODY}</article>",
    "closed button with a block": f"<body><button><div>Menu</div></button><article>{BODY}</article>",
    "wrap-footer": f'<body><div id="wrap-footer">{BODY}</div>', "newsletter-article": f'<body><div class="newsletter-article">{BODY}</div>', "notices": f'<body><div class="notices">{BODY}</div>',
    "related-work": f'<body><main><p>{PARAGRAPHS[0]}</p><section id="related-work"><p>{PARAGRAPHS[1]}</p></section></main>',
    "related-posts": f'<body><main>{BODY}</main><div class="related-posts"><p>Ten more stories about rivers, bridges and floods that you should read today.</p></div>',
    "sidebar by heading": f"<body><div>{BODY}</div><div><h3>About us</h3><p>We are a small paper of the valley and write of all that happens here every week.</p></div>",
    "comments by heading": f"<body><div>{BODY}</div><div><h3>3 responses</h3><p>Great post, I was there on the second night and it was just like that.</p><h4>Anna</h4><p>My brother lost his dog that day, and we still look for her sometimes.</p></div>",
    "comments after the article": f"<body><article>{BODY}<h2>Comments (2)</h2><p>Great post, I was there on the second night and it was just like that.</p></article>",
    "a link around blocks": f'<body><div><a href="/x"><div>Read our other long story of the flood, the bridge and the school.</div></a></div><div>{BODY}</div>',
    "an anchor that isn't closed": f'<body><div><a name="top">{BODY}</div>',
    "advert with prose": f'<body><div class="ad"><p>{PARAGRAPHS[0]}</p></div><article><p>Short, but the article.</p></article>',
}


@pytest.mark.parametrize("name", list(PAGES))
def test_pages_that_lost_or_kept_too_much(name):
    want = "Short, but the article." if name == "advert with prose" else WHOLE
    assert html_extract.main_text(PAGES[name]) == want


def test_pages_without_html(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, ""), (None, "v", BODY)], "page_id long, url string, html string").withColumn("text", F.lit("no")).withColumn("n_chars", F.lit(0))
    got = sorted((tuple(r) for r in html_extract.extract(df.drop("text", "n_chars")).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (2, None, "", 0), (None, "v", WHOLE, len(WHOLE))], key=repr)
    assert html_extract.extract(df.where("false")).count() == 0
