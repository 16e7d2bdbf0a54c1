from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import packing


def used(groups):
    out = Counter()
    for filling, times in groups:
        assert sum(filling) <= packing.LENGTH and times > 0
        for n in filling:
            out[n] += times
    return out


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, packing.LENGTH), st.integers(1, 5000), max_size=40))
def test_a_plan_places_every_piece(histogram):
    groups = packing.plan(histogram)
    assert used(groups) == Counter(histogram)
    ranks = Counter()
    for n, first, count, *_ in packing.slots(groups):
        assert first == ranks[n]
        ranks[n] += count
    assert ranks == Counter(histogram)


def test_near_the_bound():
    r = np.random.default_rng(1)
    lengths = np.clip(r.lognormal(6.5, 1, 60_000).astype(int), 1, packing.LENGTH)
    n = sum(c for _, c in packing.plan(dict(Counter(lengths.tolist()))))
    assert n <= 1.003 * -(-int(lengths.sum()) // packing.LENGTH)


def test_fit_uses_up_the_bins():
    found = packing.patterns(8, 3, 1)
    assert all(sum(p) == 8 and len(p) <= 3 for p in found) and len(set(found)) == len(found)
    counts = np.zeros(8)
    for j, p in enumerate(found[:4]):
        for b in p:
            counts[b - 1] += 100 * (j + 1)
    x = packing.fit_repeats(counts, found, 4000)
    made = np.zeros(8)
    for t, p in zip(x, found, strict=True):
        for b in p:
            made[b - 1] += t
    assert (x >= 0).all() and np.abs(made - counts).max() < 0.02 * counts.max()


def whole(texts):
    return [e.ids for e in packing.tokenizer(packing.default_tokenizer()).encode_batch(texts, add_special_tokens=False)]


WORDS = ["It's", "don't", "İstanbul", "ΣΑΣ", "Ünïcödé,", "<|endoftext|>", "<|ENDOFTEXT|>..", "foo<|endoftext|>", "é́", "²x", "Ⅷ", "ǅ,", "naïve!!", "中文,字", "ẞß", "...", "a'", "'b", "x.%%%", "WORD!!", "a.b,c", "3,4", " y", "ʼn", "ͅ"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(WORDS) | st.text(max_size=6).filter(lambda t: "\ud800" > max(t, default="a") or min(t) > "\udfff"), max_size=20).map(" ".join))
def test_ids_equal_the_whole_tokenizers(text):
    got = packing.Encoder(packing.default_tokenizer()).encode([text.encode()])[0]
    assert np.frombuffer(got, "<u4").tolist() == whole([text])[0]


def test_full_cache_changes_nothing(monkeypatch):
    texts = [f"word{i} plain text, of some words {i}!" for i in range(50)]
    want = packing.Encoder(packing.default_tokenizer()).encode([t.encode() for t in texts])
    monkeypatch.setattr(packing, "CACHE", 3)
    one = packing.Encoder(packing.default_tokenizer())
    assert [one.encode([t.encode()])[0] for t in texts] == want


def test_odd_rows_against_brute_force(spark, docs_of, odd):
    import zlib

    rows = odd + [(20, "w " * 4095), (21, "w " * 4096)] + [(i, "same text") for i in range(100, 160)]
    got = packing.pack(docs_of(rows), packing.default_tokenizer()).collect()
    want = []
    for (i, t), ids in zip(rows, whole([t or "" for _, t in rows]), strict=True):
        ids = [*ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            some = ids[start : start + 4096]
            want.append((i, piece, start, len(some), zlib.crc32(np.array(some, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(len(s) for s in sequences.values()) == len(got)


def test_empty_table(spark, docs_of):
    assert packing.pack(docs_of([(1, "x")]).limit(0), packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize("n", [1, 7, 64, 500])
def test_hot_length(n):
    groups = packing.plan({1366: n})
    assert sum(c for _, c in groups) == -(-n // 2)
