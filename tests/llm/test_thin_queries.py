"""The thin queries: against their SQL, and those without SQL against brute force over the same tables."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from fieldmark.llm import queries


def shown(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else None
    return str(x) if hasattr(x, "isoformat") else x


def wanted(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(shown(r[i]) for i in order) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(shown(x) for x in r) for r in df.select(*names).collect()), key=repr)
    assert (names, got) == wanted(sf, queries.ORACLES[name])


def test_tokens_against_a_tokenizer(spark, sf):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from fieldmark.llm.bpe import load_ranks

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in queries.op3_bpe_encode_decode(spark, sf).collect()}
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_neighbours_against_all_pairs(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    v, ids = np.stack(x["embedding"].to_numpy()).astype(float), x["vec_id"].to_numpy()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = queries.op1_ann(spark, sf).toPandas()
    hit = 0
    asked = ids[ids % 50 == 0]
    for q in asked:
        s = unit @ unit[ids == q][0]
        s[ids == q] = -9
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(got[got.query_id == q]["vec_id"]))
    assert len(got) == 5 * len(asked) and hit >= 0.9 * 5 * len(asked)


def test_spans_against_brute_force(spark, sf):
    from test_operators import PII, brute_terms, valid

    import re

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    terms = brute_terms([t for _, t in rows])
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, sf).collect()}
    for i, t in rows:
        base = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        more = [("term", m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "") if m.group().lower() in terms and not any(x < m.end() and m.start() < y for _, x, y in base)]
        place = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i]["spans"] == place(base + more) and got[i]["base_sha256"] == hashlib.sha256(place(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PII] == [sum(s[0] == k for s in base) for k in PII]


def test_pipeline_by_brute_force(spark, sf):
    """The rows of the whole pipeline from plain loops over the same documents."""
    import re
    from collections import Counter, defaultdict

    import corpus_pipeline
    from test_operators import PII, brute_kept, brute_terms, shingles, valid

    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from fieldmark.llm.bpe import load_ranks

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert len({d[0] for d in docs}) == len(docs)
    good = brute_kept(docs)
    docs = [d for d in docs if good[d[0]]]

    sets = [shingles(t, 5) for _, t, _, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            inner = len(sets[i] & sets[j])
            if inner and 100 * inner >= 80 * (len(sets[i]) + len(sets[j]) - inner):
                root[find(i)] = find(j)
    least = {}
    for k, d in enumerate(docs):
        least[find(k)] = min(least.get(find(k), d[0]), d[0])
    docs = [d for k, d in enumerate(docs) if d[0] == least[find(k)]]

    terms, mark, clean = brute_terms([d[1] for d in docs]), {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}, []
    for i, t, lang, source in docs:
        base = [(m.start(), m.end(), k) for k, p in PII.items() for m in re.finditer(p, t) if valid(k, m.group())]
        more = [(m.start(), m.end(), "term") for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if m.group().lower() in terms and not any(a < m.end() and m.start() < b for a, b, _ in base)]
        out, pos = "", 0
        for a, b, k in sorted(base + more):
            out += t[pos:a] + mark[k] if a >= pos else ""
            pos = max(pos, b)
        clean.append((i, out + t[pos:], lang, source))

    size = {i: len(t.encode().split()) for i, t, _, _ in clean}
    total, by = Counter(), defaultdict(list)
    for i, t, _, source in clean:
        total[source] += size[i]
        by[source].append((int(hashlib.md5(f"{i}\n{t}".encode()).hexdigest()[:15], 16), i))
    keys = sorted((k for k in total if k is not None)) + ([None] if None in total else [])
    weight, target, left, free = {k: (5, 2, 1)[n % 3] for n, k in enumerate(keys)}, {}, sum(total.values()), set(keys)
    while over := [k for k in free if left * weight[k] / sum(weight[x] for x in free) > 3 * total[k]]:
        target |= {k: 3 * total[k] for k in over}
        free -= set(over)
        left = sum(total.values()) - sum(target.values())
    target |= {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
    copies = {}
    for k in keys:
        fits = min(int(target[k] // total[k]), 3) if total[k] else 0
        rest, up = target[k] - fits * total[k] if fits < 3 else 0.0, 0
        copies |= {i: fits for _, i in by[k]}
        for _, i in sorted(by[k]):
            if up >= rest:
                break
            if up + size[i] <= rest or up + size[i] - rest <= rest - up:
                copies[i] += 1
            up += size[i]

    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=load_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t, lang, source in clean:
        want[i, lang, source, tuple(own.encode_ordinary(t)), True] += copies[i]
    got = Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"]), r["round_trip"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want
