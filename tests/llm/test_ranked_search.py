import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from colloquy.llm import ranked_search as rs

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    there = [c.total() for _, c in held if c.total()]
    N, L = len(there), sum(there)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        found = []
        for i, c in held:
            score = 0
            for w in terms(text):
                if w in c:
                    weight = math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1)))
                    score += weight * (1000000000 * c[w] // (1000 * c[w] + 8 * (25 + 75 * c.total() * N // L)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(str(item), n, str(None if none else i), -s) for n, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def found(spark, docs, items, **more):
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in rs.search(docs, asked, **more).collect())


def corpus(n, seed, rare=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(rare)]
    return [(i, " ".join(rng.choice(("The", "of", "and")) if rng.random() < 0.5 else words[min(int(rng.expovariate(0.08)), rare - 1)] for _ in range(rng.randrange(1, 60)))) for i in range(n)]


def test_equals_brute_force(spark, docs_of, odd):
    docs = odd + [(100 + i, t) for i, t in corpus(400, 1)] + [(900 + i, "W3 w5 w40 the") for i in range(40)]
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(("the", "of", f"w{rng.randrange(60)}")) for _ in range(rng.randrange(1, 15)))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "!!"), (53, "unheard of"), (None, "word"), (54, "a b c"), (54, "a b c"), (55, "é☃ 中文 İ"), (56, "W3 w3 W5 w40 the the of")]
    assert found(spark, docs_of(docs, 5), items) == brute(docs, items)
    assert found(spark, docs_of(docs, 3), items, k=3) == brute(docs, items, 3)


def test_items_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(rs, "ITEMS", 4)
    docs, items = corpus(120, 3), [(i, f"w{i} w{i + 7} the") for i in range(11)]
    assert found(spark, docs_of(docs), items) == brute(docs, items)


def test_fewer_accumulators_and_the_same_best():
    rng = np.random.default_rng(4)
    n, df = 5000, [5, 20, 300, 4000, 4900]
    rows = [np.sort(rng.choice(n, d, replace=False)) for d in df]
    shares = [rng.integers(300_000, 900_000, d) for d in df]
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df]
    rest = [sum(w * 900_000 for w in weights[j:]) for j in range(6)]
    item, starts = rs.Item([0, 1, 2, 3, 4], weights, rest), np.concatenate([[0], np.cumsum(df)])
    whole = np.zeros(n, np.int64)
    for r, s, w in zip(rows, shares, weights, strict=True):
        whole[r] += s * w
    score, made = rs.accumulate(item, starts, np.concatenate(rows), np.concatenate(shares), n, 10, 1)
    best = np.argsort(-whole, kind="stable")[:10]
    assert made < 400 and (np.argsort(-score, kind="stable")[:10] == best).all() and (score[best] == whole[best]).all()
    _, fewer = rs.accumulate(item, starts, np.concatenate(rows), np.concatenate(shares), n, 10, int(whole[best[-1]]))
    assert fewer <= made


def test_first_terms_leave_out_the_rest():
    item = rs.Item([7, 3, 1], [500, 300, 200], [1000, 500, 200, 0])
    assert item.first(0.5) == rs.Item([7], [500], [500, 0]) and item.first(0).terms == [7, 3, 1]


def test_terms():
    for text in ("Ab-cD_e9É中 x\x85y z", "", " ", "A" * 10, "\x00a\x7fb", "{|}~^`@[\\]"):
        assert [t.decode() for t in rs.terms_of(text.encode())] == terms(text)


def test_empty_tables(spark, docs_of):
    docs = docs_of([(1, "x")])
    assert found(spark, docs.limit(0), [(1, "x")]) == [] and found(spark, docs, []) == [] and len(found(spark, docs_of([(1, "x"), (2, "y")]), [(1, "x")])) == 1


def test_same_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(rs.SQL), rs.op11_ranked_search(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
