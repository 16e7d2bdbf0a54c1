import math
import zlib
from collections import Counter

import numpy as np

from colloquy.llm import brown_lm


def brute(rows, held_out=1):
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter()
    for i, t in rows:
        if fold(i) != held_out:
            c.update(tok(t))
    n, v = sum(c.values()), len(c)
    return [(i, fold(i) == held_out, len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t))) for i, t in rows]


def check(docs_of, rows, **limits):
    got = brown_lm.score_documents(docs_of(rows, 3)).collect()
    order = lambda r: str(r)
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=order)
    want = brute(rows)
    assert have == sorted((w[:5] for w in want), key=order)
    assert np.allclose(sorted(r["base_score"] for r in got), sorted(w[5] for w in want))
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) and abs(math.log10(r["perplexity"]) + r["score"] / r["n_tokens"]) < 1e-9 for r in got)


def texts(n=60):
    r = np.random.default_rng(3)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(12)]
    return [(i, " ".join(x for _ in range(30) for x in (r.choice(nouns), r.choice(verbs))) + f" Rare{i}") for i in range(n)]


def test_base_equals_brute_force(spark, docs_of, odd, monkeypatch):
    check(docs_of, texts() + odd)
    monkeypatch.setattr(brown_lm, "KNOWN", 5)  # most words then join the table of counts
    check(docs_of, texts() + odd)


def test_small_batches_give_the_same(spark, docs_of, odd, monkeypatch):
    monkeypatch.setattr(brown_lm, "KNOWN", 5)
    rows = texts() + odd
    key = lambda r: (str(r["doc_id"]), round(r["score"], 6), round(r["base_score"], 6), r["n_known"])
    want = sorted(map(key, brown_lm.score_documents(docs_of(rows, 3)).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(docs_of, rows)
        assert sorted(map(key, brown_lm.score_documents(docs_of(rows, 3)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark, docs_of):
    assert brown_lm.score_documents(docs_of([(1, "x")]).limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = brown_lm.score_documents(docs_of([(held, "a b")])).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 3) and row["base_score"] == 0.0


def test_exchange_finds_classes_and_never_loses_likelihood():
    r = np.random.default_rng(5)
    m = np.zeros((brown_lm.UNITS, brown_lm.UNITS))
    for _ in range(20_000):  # units 0-9 are followed by 10-19 and the other way round
        a, b = r.integers(0, 10), r.integers(10, 20)
        m[a, b] += 1
        m[b, r.integers(0, 10)] += 1

    def likelihood(cls):
        k = np.zeros((len(cls), brown_lm.CLASSES))
        k[np.arange(len(cls)), cls] = 1
        t = k.T @ m @ k
        f = brown_lm._xlogx
        return f(t).sum() - f(t.sum(0)).sum() - f(t.sum(1)).sum()

    values = [likelihood(brown_lm.exchange(m, sweeps=s)) for s in (0, 1, 3)]
    assert values[0] <= values[1] + 1e-6 <= values[2] + 2e-6
    cls = brown_lm.exchange(m, classes=3, sweeps=5)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10]


def test_transitions_are_probabilities():
    r = np.random.default_rng(6)
    step = brown_lm.transitions(r.poisson(2, (brown_lm.CLASSES, brown_lm.CLASSES)).astype(float))
    assert np.allclose((10.0**step).sum(1), 1)


def brute_contexts(rows, units):
    out = Counter()
    for _, t in rows:
        seq = [b"", *(t or "").encode().lower().split(), b""]
        unit = [units[w] if w in units else brown_lm.ending(w) for w in seq]
        for i in range(len(seq) - 1):
            out[seq[i], unit[i + 1]] += 1
            out[seq[i + 1], brown_lm.UNITS + unit[i]] += 1
    return out


def test_contexts_equal_brute_force(spark, docs_of, odd, monkeypatch):
    rows = texts(30) + odd
    units = {b"n1": 0, b"v3": 1, b"": brown_lm.END_UNIT}
    for cache in (brown_lm.CACHE, 7):
        monkeypatch.setattr(brown_lm, "CACHE", cache)
        got = {}
        for r in brown_lm.contexts(docs_of(rows, 5), units).collect():
            for k, n in zip(np.frombuffer(r["context"], "<u4").tolist(), np.frombuffer(r["n"], "<u4").tolist(), strict=True):
                assert (bytes(r["token"]), k) not in got
                got[bytes(r["token"]), k] = n
        assert got == dict(brute_contexts(rows, units))


def test_score_equals_brute_force(spark, docs_of, odd, monkeypatch):
    monkeypatch.setattr(brown_lm, "KNOWN", 12)  # most words join the table of classes
    rows = texts(80) + odd + [(1000 + i, f"unseen{i} words{i} n1 v2 and{i} n3") for i in range(30)]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    docs = docs_of(rows, 3).select("doc_id", "text")
    training = docs_of([r for r in rows if fold(r[0]) != 1], 2)
    model = brown_lm.Model(training, top=10)
    classes = {bytes(r["token"]): (r["c"], r["cls"]) for r in model.classes.collect()}
    counts = Counter()
    for _, t in (r for r in rows if fold(r[0]) != 1):
        counts.update([*(t or "").encode().lower().split(), b""])
    assert {w: c for w, (c, _) in classes.items()} == dict(counts)
    # class bigrams and emission masses of the final classes
    mass, types = np.zeros(brown_lm.CLASSES), np.zeros(brown_lm.CLASSES)
    for c, k in classes.values():
        mass[k] += c
        types[k] += 1
    assert np.allclose(model.emit, np.log10(mass + 0.5 * (types + 1)))
    assert np.allclose((10**model.step).sum(1), 1)

    def score(t):
        total, before = 0.0, brown_lm.CLASSES - 1
        for w in [*(t or "").encode().lower().split(), b""]:
            c, k = classes.get(w, (0, int(model.unseen[brown_lm.ending(w) - brown_lm.TOP])))
            total += model.step[before, k] + math.log10(c + 0.5) - model.emit[k]
            before = k
        return total

    got = brown_lm.score_texts(docs.withColumnRenamed("doc_id", "key"), model).collect()
    assert np.allclose(sorted(r["score"] for r in got), sorted(score(t) for _, t in rows))
    assert sorted((str(r["key"]), round(r["score"], 6)) for r in got) == sorted((str(i), round(score(t), 6)) for i, t in rows)


def test_rare_words_have_classes_of_their_contexts(spark, docs_of):
    r = np.random.default_rng(4)
    common = [["the", "a", "my"], ["saw", "took", "had"]]
    rare = [[f"{x}{i}" for i in r.permutation(200)[:60]] for x in ("cat", "run")]
    rows = [(i, " ".join(w for _ in range(20) for w in (r.choice(common[0]), r.choice(rare[0]), r.choice(common[1]), r.choice(rare[1])))) for i in range(120)]
    cls = {bytes(x["token"]).decode(): x["cls"] for x in brown_lm.Model(docs_of(rows, 3), top=12).classes.collect()}
    kinds = [Counter(cls[w] for w in words if w in cls) for words in rare]
    assert not set(kinds[0]) & set(kinds[1])  # no class holds words of both kinds


def test_the_model_beats_the_base_on_held_out_text(spark, docs_of):
    rows = [r for r in brown_lm.score_documents(docs_of(texts(150), 3)).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
