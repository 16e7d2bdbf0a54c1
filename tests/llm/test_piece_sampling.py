import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import piece_sampling as ps

VOC = ps.vocabulary(ps.default_model())


def every(text):
    """All segmentations with their normalised log-probabilities."""
    text, out = " " + text, {}
    known = {VOC.bytes[i].decode(): (int(i), w) for i, w in zip(VOC.ids, VOC.weights, strict=True)}

    def go(at, ids, weight):
        if at == len(text):
            out[ids] = weight
            return
        for end in range(at + 1, min(len(text), at + ps.LONGEST) + 1):
            if text[at:end] in known:
                i, w = known[text[at:end]]
                go(end, (*ids, i), weight + w)
            elif end == at + 1:
                raw = text[at].encode()
                go(end, (*ids, *[VOC.byte_id + b for b in raw]), weight + VOC.byte_weight * len(raw))

    go(0, (), 0.0)
    total = math.log(sum(map(math.exp, out.values())))
    return {k: v - total for k, v in out.items()}


@pytest.mark.parametrize("text", ["thon", "a b", "é☃x", "in\nit"])
def test_draws_follow_the_enumerated_lattice(text):
    want, n, k = every(text), 3000, 3
    drawn = ps.sample([text] * n, ps.mix(np.arange(n, dtype=np.uint64)), VOC, k)
    first = Counter()
    for rows in drawn:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == len(ids) == min(k, len(want))
        for i, (_, logp, q) in zip(ids, rows, strict=True):
            assert abs(logp - want[i]) < 1e-4 and 0 < q <= 1
        first[ids[0]] += 1
    for ids, logp in want.items():
        p = math.exp(logp)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    # inclusion scores make weighted sums unbiased
    assert abs(np.mean([sum(math.exp(r[1]) / r[2] for r in rows) for rows in drawn]) - 1) < 0.02


def test_second_draws_are_without_replacement():
    text = "thon"
    want = every(text)
    n = 4000
    drawn = ps.sample([text] * n, ps.mix(np.arange(n, dtype=np.uint64) + np.uint64(10**6)), VOC, 2)
    top, other = sorted(want, key=want.get)[-1:-3:-1]
    after = [tuple(rows[1][0].tolist()) for rows in drawn if tuple(rows[0][0].tolist()) == top]
    p = math.exp(want[other]) / (1 - math.exp(want[top]))
    assert abs(sum(a == other for a in after) / len(after) - p) < 5 * math.sqrt(p * (1 - p) / len(after)) + 1e-3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40).filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t)), min_size=1, max_size=6))
def test_round_trip(texts):
    for text, rows in zip(texts, ps.sample(texts, ps.mix(np.arange(len(texts), dtype=np.uint64)), VOC, 4), strict=True):
        assert rows and all(ps.decode_ids(r[0].tolist(), VOC) == text for r in rows)
        assert len({tuple(r[0].tolist()) for r in rows}) == len(rows)


def test_a_row_draws_the_same_in_any_company():
    texts = [f"some words of text {i}" for i in range(20)]
    seeds = ps.mix(np.arange(20, dtype=np.uint64))
    together = ps.sample(texts, seeds, VOC, 3)
    for i in range(20):
        alone = ps.sample([texts[i]], seeds[i : i + 1], VOC, 3)[0]
        assert [r[0].tolist() for r in alone] == [r[0].tolist() for r in together[i]]


def test_odd_rows(spark, docs_of, odd):
    path = ps.default_model()
    got = ps.encode_samples(docs_of(odd), path)
    rows = got.collect()
    assert {(r["logp"], r["inclusion"], tuple(r["ids"])) for r in rows if r["doc_id"] in (1, 2)} == {(0.0, 1.0, ())}
    back = {(r["doc_id"], r["sample"]): r["text"] for r in ps.decode(got, path, keep=["sample"]).collect()}
    want = {i: t or "" for i, t in odd}
    assert all(text == want[i] for (i, _), text in back.items())
    twice = [tuple(r["ids"]) for r in rows if r["doc_id"] == 4 and r["sample"] == 0]
    assert len(twice) == 2 and len(set(twice)) == 1
    assert ps.encode_samples(docs_of(odd).limit(0), path).count() == 0
