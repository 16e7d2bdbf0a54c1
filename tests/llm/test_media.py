import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import media


def padded(data):
    return data + b"\xff" * (-len(data) % 576 or (0 if data else 576))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5))
def test_stored_bytes_come_back(payloads):
    for data, thumb in zip(payloads, media.thumbnails(media.encode_texts(payloads)), strict=True):
        assert thumb[2].tobytes()[: len(padded(data))] == padded(data)


def test_very_long_payload_stays_within_the_format():
    data = bytes(range(256)) * 3000
    image = media.encode_texts([data])[0]
    x = media.parse(image)
    assert max(x["width"], x["height"]) <= 65_535 and media.thumbnails([image])[0][2].tobytes()[: len(data)] == data


def test_payloads_beyond_one_image_are_several(spark, docs_of, monkeypatch):
    assert media.geometry(media.MOST)[0] * 8 <= 65_535 and media.geometry(media.MOST)[1] <= 8191
    monkeypatch.setattr(media, "MOST", 576 * 3)
    texts = ["a" * 10_000, "b" * 576 * 3, "c" * (576 * 3 + 1), ""]
    data = [t.encode() for t in texts]
    stored = media.encode_texts(data)
    assert [len(media.split_images(m)) for m in stored] == [6, 1, 2, 1]
    for d, m in zip(data, stored, strict=True):
        assert b"".join(x[2].tobytes()[: 576 * 3] for x in media.thumbnails(media.split_images(m)))[: len(padded(d))] == padded(d)


def bits_of(table):
    return {s: format(c, f"0{n}b") for s, c, n in media.canonical(*table)}


def colour_image(levels, restart=0, seed=0):
    """A 4:2:0 image by a plain encoder: luminance levels of 8 x 8 blocks, with AC coefficients that a thumbnail passes over."""
    r = np.random.default_rng(seed)
    dc = bits_of((media.DC_BITS, media.DC_SYMBOLS))
    ac_table = ([0, 1, 2, 1] + [0] * 12, [0x00, 0x01, 0x12, 0xF0])
    ac = bits_of(ac_table)
    down, across = levels.shape[0] // 2, levels.shape[1] // 2
    pred, out, bits, n = [0, 0, 0], b"", "", 0

    def number(v):
        size = int(abs(v)).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for y in range(down):
        for x in range(across):
            for c, values in ((0, [int(levels[2 * y + j, 2 * x + i]) - 128 for j in (0, 1) for i in (0, 1)]), (1, [int(r.integers(-100, 100))]), (2, [int(r.integers(-100, 100))])):
                for v in values:
                    size, extra = number(v - pred[c])
                    bits, pred[c] = bits + dc[size] + extra, v
                    for _ in range(int(r.integers(0, 3))):
                        bits += ac[0x01] + str(r.integers(0, 2))
                    if r.integers(0, 2):
                        bits += ac[0xF0] + ac[0x12] + "10"
                    bits += ac[0x00]
            n += 1
            if restart and n % restart == 0 and n < down * across:
                out += flush(bits) + bytes([255, 0xD0 + (n // restart - 1) % 8])
                bits, pred = "", [0, 0, 0]
    out += flush(bits)
    part = lambda m, b: bytes([255, m]) + (len(b) + 2).to_bytes(2, "big") + b
    head = b"\xff\xd8" + part(0xFE, b"a comment") + part(0xDB, b"\0" + bytes([8] + [1] * 63)) + part(0xC0, b"\x08" + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0")
    head += part(0xC4, b"\0" + bytes(media.DC_BITS) + bytes(media.DC_SYMBOLS)) + part(0xC4, b"\x10" + bytes(ac_table[0]) + bytes(ac_table[1]))
    return head + (part(0xDD, restart.to_bytes(2, "big")) if restart else b"") + part(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + out + b"\xff\xd9"


def test_colour_subsampling_ac_and_restarts():
    r = np.random.default_rng(2)
    levels = [r.integers(0, 256, (6, 8)), r.integers(0, 256, (2, 2)), r.integers(0, 256, (10, 4))]
    images = [colour_image(x, restart, i) for i, x in enumerate(levels) for restart in (0, 3)]
    for got, want in zip(media.thumbnails(images), [x for x in levels for _ in range(2)], strict=True):
        assert got[:2] == (want.shape[1] * 8, want.shape[0] * 8) and (got[2] == want).all()


def test_broken_images_have_no_features():
    good = media.encode_texts([b"text" * 200])[0]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    got = media.thumbnails([good, b"", b"no image", good[:60], progressive, good])
    assert [g is not None for g in got] == [True, False, False, False, False, True]


def test_odd_rows(spark, docs_of, odd):
    got = media.features(media.encode(docs_of(odd))).collect()
    assert len(got) == len(odd)
    texts = {i: (t or "").encode() for i, t in odd}
    for r in got:
        data = padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-32:])
    for some in ((1, 2), (4, 8)):
        assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] in some}) == 1
    assert media.features(media.encode(docs_of(odd).limit(0))).count() == 0
    null = spark.createDataFrame([(1, 0, None), (2, 3, b"junk")], "doc_id bigint, n_bytes bigint, media binary")
    assert {r["feature"] for r in media.features(null).collect()} == {None}


def test_stored_form_is_lossless_for_pixels_too():
    """Each block is flat, so its level is that of all its 64 pixels after the inverse transform: DC * 8 / 8 + 128."""
    x = media.thumbnails(media.encode_texts([bytes(range(256)) * 9]))[0][2]
    assert x.min() == 0 and x.max() == 255
