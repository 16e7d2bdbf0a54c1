from collections import Counter, defaultdict

import os

import numpy as np
import pytest

from colloquy.llm import jaccard_join as jj

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Per row: (id, class, links), by all pairs of distinct sets of word 5-grams."""
    def grams(t):
        w = (t or "").encode().split()
        k = min(5, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    distinct = list(dict.fromkeys(sets))
    parent, links = list(range(len(distinct))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            both = len(a & distinct[j])
            if both and 9 * both >= 4 * (len(a) + len(distinct[j])):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    at = {s: i for i, s in enumerate(distinct)}
    least = defaultdict(list)
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None:
            least[root(at[s])].append(i)
    return sorted(((i, min(least[root(at[s])], default=None), links[at[s]]) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def near_copies(seed=1, bases=4, copies=60, words=160):
    r = np.random.default_rng(seed)
    rows = []
    for b in range(bases):
        base = [f"b{b}w{x}" for x in r.integers(0, 60, words)]
        for _ in range(copies if b == 0 else 8):
            t = list(base)
            for _ in range(r.integers(0, 5)):
                at = r.integers(0, len(t))
                kind = r.integers(0, 3)
                if kind == 0:
                    t[at] += "X" + str(r.integers(0, 3))
                elif kind == 1:
                    del t[at]
                else:
                    t.insert(at, "new" + str(r.integers(0, 3)))
            rows.append((len(rows) + 10, " ".join(t)))
    rows += [(len(rows) + 10 + i, " ".join(f"u{x}" for x in r.integers(0, 10**6, 50))) for i in range(40)]
    return rows


def found(df):
    return sorted(((r["doc_id"], r["group"], r["n_links"]) for r in df.collect()), key=str)


def test_equals_brute_force(spark, docs_of):
    rows = near_copies()
    assert found(jj.link_groups(docs_of(rows, 4))) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_links_of_the_given_documents(spark):
    """All links of the documents whose id is divisible by 20, by brute force against all."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sets = {i: frozenset(jj.grams(t.encode()).tolist()) for i, t in docs.items()}
    distinct = set(sets.values())
    got = {r["doc_id"]: r["n_links"] for r in jj.op8_jaccard_join(spark, SF).collect()}
    for i in (i for i in docs if i % 20 == 0):
        assert got[i] == sum(s != sets[i] and 9 * len(s & sets[i]) >= 4 * (len(s) + len(sets[i])) for s in distinct if s and sets[i]), i


def test_odd_rows(spark, docs_of, odd):
    rows = odd + [(30, "a  b\tc"), (31, "a b c d e"), (32, "a b c d e f"), (33, None)]
    got = jj.link_groups(docs_of(rows))
    assert found(got) == brute(rows)
    assert jj.link_groups(docs_of(rows).limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark, docs_of, odd):
    rows = odd + near_copies(2, 2, 20)
    docs = docs_of(rows)
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns
    want = {g for _, g, _ in brute(rows)}
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    assert jj.keep_one(docs.limit(0)).count() == 0


def test_bayesian_table():
    table = jj.least_matches()
    assert [n for n, _ in table] == list(range(jj.STEP, jj.ROWS * jj.BANDS + 1, jj.STEP))
    assert all(0 < m < 0.8 * n for n, m in table)
    r = np.random.default_rng(3)
    for n, m in table:  # pairs at the threshold survive
        assert (r.binomial(n, 0.8, 100_000) < m).mean() < 1e-3


def test_minhash_estimates_similarity():
    r = np.random.default_rng(4)
    a = np.unique(r.integers(-(2**62), 2**62, 900))
    b = np.concatenate([a[:800], np.unique(r.integers(-(2**62), 2**62, 100))])
    share = (jj.minhash(a) == jj.minhash(np.sort(b))).mean()
    assert abs(share - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.1


def test_components_of_a_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n)] + [(bytes([100]), bytes([101]))], "a binary, b binary")
    got = {bytes(r["node"]): bytes(r["component"]) for r in jj.components(edges).collect()}
    assert {got[bytes([i])] for i in range(n + 1)} == {b"\x00"} and got[b"e"] == b"d"


def test_small_blocks_equal_brute_force(spark, docs_of, monkeypatch):
    units, meet = jj.count_in_units, jj.meet
    monkeypatch.setattr(jj, "count_in_units", lambda members: units(members, block=5, most_grams=300))
    monkeypatch.setattr(jj, "meet", lambda places, nodes: meet(places, nodes, block=3))
    monkeypatch.setattr(jj, "HOME", (3, 4))  # more homes, so that more pairs are of different ones
    rows = near_copies(9, 3, 40)
    assert found(jj.link_groups(docs_of(rows, 4))) == brute(rows)


def test_overlaps_either_way():
    r = np.random.default_rng(5)
    parts = [np.unique(r.integers(0, 9000, 800)) for _ in range(12)]
    x, y = np.triu_indices(12, 1)
    want = [len(np.intersect1d(parts[i], parts[j])) for i, j in zip(x, y, strict=True)]
    assert jj.overlaps(parts, x, y).tolist() == want and jj.overlaps(parts, x[:9], y[:9]).tolist() == want[:9]


def test_columns_of_any_name_stay(spark):
    rows = [(i, f"a b c d e f {i % 3}", "keep me", "x", "y") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, _digest string, first_key string")
    kept = jj.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {("keep me", "x", "y")} and kept.count() == 3


def test_full_buckets_equal_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(jj, "DOORS", 0, raising=False)  # all pairs of different homes meet by their rarest grams
    rows = near_copies(6, 5, 30)
    assert found(jj.link_groups(docs_of(rows, 4))) == brute(rows)


def test_texts_that_share_a_passage_are_not_all_paired(spark, docs_of, monkeypatch):
    monkeypatch.setattr(jj, "DOORS", 2, raising=False)
    r = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(62))
    rows = [(i, passage + " " + " ".join(f"u{x}" for x in r.integers(0, 10**9, 95))) for i in range(800)]
    rows += [(900, rows[0][1] + " more"), (901, rows[1][1] + " more")]
    pairs, prune, meet = [], jj.prune, jj.meet

    def counted(found, nodes, threshold=jj.THRESHOLD):
        if threshold == jj.THRESHOLD:
            pairs.append(found.count())
        return prune(found, nodes, threshold)

    def met(places, nodes):
        sizes = [r["count"] for r in places.groupBy("place").count().collect()]
        pairs.append(sum(n * (n - 1) // 2 for n in sizes))  # pairs looked at, not only those that survive
        return meet(places, nodes)

    monkeypatch.setattr(jj, "prune", counted)
    monkeypatch.setattr(jj, "meet", met)
    got = {r["doc_id"]: r["n_links"] for r in jj.link_groups(docs_of(rows, 4)).collect()}
    assert {i for i, n in got.items() if n} == {0, 1, 900, 901}
    assert sum(pairs) < 200, pairs
