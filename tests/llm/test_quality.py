import math
import os

import numpy as np
import pytest

from colloquy.llm import quality

SF = "/root/testdata/sf0.01"


def corpus(n=240):
    r = np.random.default_rng(1)
    words = ["the", "stone", "river", "is", "old", "and", "green", "under", "light"]
    good = [" ".join(r.choice(words, 40)) + "." for _ in range(n)]
    bad = [" ".join(w + "***" for w in r.choice(words, 40)) if i % 2 else " ".join(w.upper() + "!!" for w in r.choice(words, 40)) for i in range(n)]
    return good, bad


def test_held_out_accuracy():
    good, bad = corpus()
    net = quality.Network().fit([t.encode() for t in good[:120] + bad[:120]], [1] * 120 + [0] * 120)
    up, down = (net.score([t.encode() for t in x[120:]]) for x in (good, bad))
    assert (up >= quality.THRESHOLD).mean() >= 0.98 and (down < quality.THRESHOLD).mean() >= 0.95


def test_gradient_is_the_slope():
    net = quality.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data = bytes(range(200))
    loss = lambda: -np.log(net.score([data])[0])
    grads = {k: np.zeros(v.shape) for k, v in net.w.items()}
    net._gradients(data, 1.0, 1.0, grads)
    for name in ("out", "filter", "embed", "shift"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        eps, old = 1e-5, net.w[name][at]
        net.w[name][at] = old + eps
        up = loss()
        net.w[name][at] = old - eps
        down = loss()
        net.w[name][at] = old
        assert np.isclose((up - down) / (2 * eps), grads[name][at], rtol=1e-2)


def naive_score(net, data):
    """The forward pass, number by number."""
    step, w = quality.STEP, {k: v.astype(float) for k, v in net.w.items()}
    n = max(2, -(-len(data) // step))
    ids = list(data) + [256] * (n * step - len(data))
    act = []
    for i in range(n - 1):
        x = [w["embed"][b][e] for b in ids[i * step : (i + 2) * step] for e in range(quality.EMBED)]
        act.append([max(0.0, sum(x[j] * w["filter"][j][f] for j in range(len(x))) + w["shift"][f]) for f in range(quality.FILTERS)])
    half = quality.STRETCH // 2
    means = []
    for start in range(0, max(1, len(act) - half), half):
        some = act[start : start + quality.STRETCH]
        means.append([sum(a[f] for a in some) / len(some) for f in range(quality.FILTERS)])
    pooled = [max(a[f] for a in act) for f in range(quality.FILTERS)] + [max(m[f] for m in means) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-(sum(p * o for p, o in zip(pooled, w["out"], strict=True)) + w["bias"][0])))


def test_score_equals_brute_force():
    good, bad = corpus(20)
    net = quality.Network().fit([t.encode() for t in good + bad], [1] * 20 + [0] * 20, epochs=2)
    texts = [b"", b"a", b"abcd", b"abcde", good[0].encode(), bad[1].encode(), bytes(range(256)), ("é☃ " * 70).encode()]
    assert np.allclose(net.score(texts), [naive_score(net, t) for t in texts], atol=1e-5)


def test_very_long_texts_are_scored_but_not_learned(spark, docs_of):
    docs = docs_of([(i, "word " * 30_000 if i == 3 else f"text {i}") for i in range(6)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id bigint, quality int, toxic int")
    assert len(quality.sample(docs, labels, None)) == 5
    assert quality.classify(docs, quality.Network()).count() == 6


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_held_out_rows_of_the_given_labels(spark):
    found = quality.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    rows = found.collect()
    good, poor = ([r["predicted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.95 and 1 - sum(poor) / len(poor) > 0.4, (len(good), len(poor), sum(good), sum(poor))


def test_the_whole_text_counts():
    good, bad = corpus()
    net = quality.Network().fit([t.encode() for t in good[:120] + bad[:120]], [1] * 120 + [0] * 120)
    tail = (" ".join(good[120:200]) + " " + bad[130]).encode()
    assert net.score([tail])[0] < net.score([" ".join(good[120:200]).encode()])[0]


def test_odd_rows(spark, docs_of, odd):
    good, bad = corpus(30)
    net = quality.Network().fit([t.encode() for t in good + bad], [1] * 30 + [0] * 30, epochs=2)
    rows = quality.classify(docs_of(odd), net).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= quality.THRESHOLD) for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (4, 8)}
    assert len(same) == 1 and len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.classify(docs_of([(1, "x")]).limit(0), net).count() == 0
    kept = quality.drop_rejected(docs_of(odd), net)
    assert kept.columns == docs_of(odd).columns and kept.count() == sum(r["predicted"] for r in rows)


def test_training_without_both_labels(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(20)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        assert {r["score"] for r in quality.classify(docs, quality.train(docs, some)).collect()} == {0.5}


def test_the_sample_leaves_the_fold_out(spark, docs_of):
    import zlib

    docs = docs_of([(i, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    got = quality.sample(docs, labels, 0, size=100)
    want = {f"text {i}".encode() for i in range(50) if zlib.crc32(str(i).encode()) % 5}
    assert {t for t, _ in got} == want and len(quality.sample(docs, labels, 0, size=3)) == 6
