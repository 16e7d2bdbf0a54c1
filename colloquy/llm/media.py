"""Media columns as baseline JPEG.

``encode`` stores the UTF-8 bytes of a text, padded with 255 to a positive multiple of 576, as a greyscale baseline JPEG: each
payload byte is the level of one 8 x 8 block, so it is the block's only (DC) coefficient and survives exactly. Blocks stand 24 to
a row (a multiple of 24 for long payloads, to stay under the format's 65,535 rows), with a restart marker after each 24. A payload of
more blocks than one image can hold (MOST) is stored as several images, one after the other.

``features`` parses any baseline JPEG's markers, Huffman-decodes its scan and rebuilds the DC-only luminance thumbnail. Restart
segments of all images of a batch that share their tables are decoded in step, one symbol of every segment at a time, so the serial
Huffman code runs on numpy vectors.

Null and empty texts store one padded block row (576 bytes of 255). Equal texts give equal values, repeated rows each their own. A
stored value that is not a baseline JPEG gives null features. Columns of any name pass by; an empty table gives no rows. Texts of any
length are stored whole; a worker's memory grows with the longest one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, per_batch, read_table

UNIT, SEGMENT, SLICE = 576, 24, 1 << 16
#: Payload bytes of one image: 8,184 blocks across and 8,191 down are the format's limit.
MOST = 8184 * 8191 // UNIT * UNIT

# Fixed values of the JPEG standard (ITU-T T.81, table K.3): codes of each length 1..16, and their symbols.
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
#: Our AC table has the end-of-block symbol alone, one bit long.
AC_BITS, AC_SYMBOLS = [1] + [0] * 15, [0]


def canonical(bits: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a table, codes counted up within each length."""
    code, out, left = 0, [], iter(symbols)
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out.append((next(left), code, length))
            code += 1
        code <<= 1
    return out


def lookup(bits: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16-bit peek: symbol * 32 + code length, 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in canonical(bits, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return table


def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    codes, lengths = np.zeros(12, np.int64), np.zeros(12, np.int64)
    for symbol, code, length in canonical(DC_BITS, DC_SYMBOLS):
        codes[symbol], lengths[symbol] = code, length
    return codes, lengths


DC_CODE, DC_LENGTH = _dc_codes()


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Code and width of a block by its difference plus 255: DC code, difference bits, end of block."""
    diff = np.arange(-255, 256)
    cat = np.array([int(abs(d)).bit_length() for d in diff])
    return ((DC_CODE[cat] << cat) | np.where(diff < 0, diff + (1 << cat) - 1, diff)) << 1, (DC_LENGTH[cat] + cat + 1).astype(np.int32)


STEP_CODE, STEP_WIDTH = _steps()


def geometry(n: int) -> tuple[int, int]:
    """Blocks across and down for a payload of n bytes (a multiple of 576)."""
    across = SEGMENT
    while -(-n // across) > 8191:
        across += SEGMENT
    return across, -(-n // across)


def header(across: int, down: int) -> bytes:
    def part(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 255, marker, len(body) + 2) + body

    return (
        b"\xff\xd8"
        + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + part(0xDB, b"\0" + bytes([8] + [1] * 63))
        + part(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\1\x11\0")
        + part(0xC4, b"\0" + bytes(DC_BITS) + bytes(DC_SYMBOLS))
        + part(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_SYMBOLS))
        + part(0xDD, struct.pack(">H", SEGMENT))
        + part(0xDA, b"\1\1\0\0\x3f\0")
    )


def _code_segments(samples: np.ndarray, markers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of rows of 24 samples, each row closed by its marker; the bytes of each row."""
    step = np.empty(samples.shape, np.int32)  # difference to the sample before, plus 255
    np.subtract(samples[:, 1:], samples[:, :-1], out=step[:, 1:], dtype=np.int32)
    step[:, 1:] += 255
    step[:, 0] = samples[:, 0].astype(np.int32) + 127
    value, width = STEP_CODE[step].ravel(), STEP_WIDTH[step]
    bits = width.sum(1)
    size = (bits + 7) >> 3
    start = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=start[1:])
    at = (start[:-1, None] * 8 + np.cumsum(width, axis=1, dtype=np.int32) - width).ravel()
    pad = size * 8 - bits  # filled with ones
    at, width, value = np.concatenate([at, start[:-1] * 8 + bits]), np.concatenate([width.ravel(), pad]), np.concatenate([value, (1 << pad) - 1])
    word, room = at >> 5, 64 - (at & 31) - width
    both = value << room  # at most 15 bits, over two 32-bit words
    n = int(start[-1] // 4 + 2)
    packed = np.bincount(word, weights=(both >> 32).astype(float), minlength=n) + np.bincount(word + 1, weights=(both & 0xFFFFFFFF).astype(float), minlength=n)[:n]
    stream = np.frombuffer(packed.astype(">u4").tobytes(), np.uint8)[: start[-1]]
    full = stream == 255
    row = np.repeat(np.arange(len(size)), size)
    stuffed = np.cumsum(full)
    to = np.arange(len(stream)) + stuffed - full + 2 * row
    out = np.zeros(len(stream) + int(stuffed[-1]) + 2 * len(size), np.uint8)  # a zero follows each stuffed 255
    out[to] = stream
    end = start[1:] + stuffed[start[1:] - 1] + 2 * np.arange(len(size))
    out[end], out[end + 1] = 255, markers
    return out.tobytes(), np.diff(end + 2, prepend=0)


def encode_texts(texts: list[bytes]) -> list[bytes]:
    """A JPEG for each payload (several in a row beyond MOST bytes), all payloads coded together in slices of bounded size."""
    padded = [t + b"\xff" * (-len(t) % UNIT or (0 if t else UNIT)) for t in texts]
    each = [-(-len(p) // MOST) for p in padded]
    images = iter(_encode_images([p[i : i + MOST] for p in padded for i in range(0, len(p), MOST)]))
    return [b"".join([next(images) for _ in range(n)]) for n in each]


def _encode_images(padded: list[bytes]) -> list[bytes]:
    shapes = [geometry(len(p)) for p in padded]
    padded = [p + b"\xff" * (a * d - len(p)) for p, (a, d) in zip(padded, shapes, strict=True)]
    rows = np.array([len(p) // SEGMENT for p in padded], np.int64)
    first = np.cumsum(rows) - rows
    inside = np.arange(int(rows.sum())) - np.repeat(first, rows)
    markers = (0xD0 + inside % 8).astype(np.uint8)
    markers[first + rows - 1] = 0xD9  # the last row is closed by the end of the image
    samples = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, SEGMENT)
    parts = [_code_segments(samples[i : i + SLICE], markers[i : i + SLICE]) for i in range(0, len(samples), SLICE)]
    scan, size = b"".join(p for p, _ in parts), np.concatenate([s for _, s in parts])
    ends = np.cumsum(size)[first + rows - 1]
    return [header(*shape) + scan[a:b] for shape, a, b in zip(shapes, [0, *ends[:-1]], ends, strict=True)]


def split_images(data: bytes) -> list[bytes]:
    """The images of a stored value: each ends at the end marker of its scan."""
    out, at = [], 0
    while data[at : at + 2] == b"\xff\xd8":
        try:
            end = data.find(b"\xff\xd9", parse(data[at:])["scan"] + at)
        except (NotBaseline, IndexError, struct.error):
            break
        if end < 0:
            break
        out.append(data[at : end + 2])
        at = end + 2
    return out if out and at == len(data) else [data]


class NotBaseline(ValueError):
    """The bytes are no baseline JPEG."""


def parse(data: bytes) -> dict:
    """Markers up to the scan: size, components, tables, restart interval and the scan's place."""
    if data[:2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    at, out = 2, {"dc": {}, "ac": {}, "q": {}, "restart": 0, "frame": None}
    while at + 4 <= len(data):
        if data[at] != 255:
            raise NotBaseline("marker expected")
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["q"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                kind, bits = body[0], list(body[1:17])
                n = sum(bits)
                out["ac" if kind >> 4 else "dc"][kind & 15] = (tuple(bits), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            out |= {"height": height, "width": width, "frame": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise NotBaseline("not a baseline frame")
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if not out["frame"] or any(c[0] not in chosen for c in out["frame"]) or not out["width"] or not out["height"]:
                raise NotBaseline("scan without its frame")
            return out | {"scan": at, "chosen": chosen}
    raise NotBaseline("no scan")


def _dc_values(scans: list[bytes], per_mcu: list[tuple[int, tuple, tuple]], mcus: list[int], restart: int) -> list[np.ndarray]:
    """DC coefficients (before scaling) of all blocks of scans that share their tables: an array MCU x block for each."""
    data = np.frombuffer(b"".join(scans) + b"\0\0", np.uint8)
    ff = np.flatnonzero(data[:-1] == 255)
    after = data[ff + 1]
    keep = np.ones(len(data), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    ends = ff[after == 0xD9]
    keep[marks] = keep[marks + 1] = keep[ends] = keep[ends + 1] = False
    place = np.cumsum(keep) - keep
    stream = data[keep]
    edges = np.cumsum([0, *map(len, scans)])
    counts = [-(-m // restart) if restart else 1 for m in mcus]
    found = np.searchsorted(marks, edges)
    if any(found[i + 1] - found[i] != c - 1 for i, c in enumerate(counts)):
        raise NotBaseline("restart markers missing")
    start = np.empty(sum(counts), np.int64)
    first = np.cumsum([0, *counts])
    is_first = np.zeros(len(start), bool)
    is_first[first[:-1]] = True
    start[is_first], start[~is_first] = place[edges[:-1]], place[marks + 2]
    blocks = len(per_mcu)
    todo = np.full(len(start), restart, np.int64)
    for i, m in enumerate(mcus):
        todo[first[i + 1] - 1] = m - restart * (counts[i] - 1)
    order = np.argsort(-todo, kind="stable")
    todo, pos = todo[order], start[order] * 8
    padded = np.concatenate([stream, np.zeros(16, np.uint8)])
    window = np.ndarray(len(stream) + 8, ">u8", padded, strides=(1,))  # the eight bytes from each byte on
    limit = len(window) * 8 - 8
    components = sorted({c for c, _, _ in per_mcu})
    pred = {c: np.zeros(len(start), np.int32) for c in components}
    result = np.zeros((int(todo[0]), blocks, len(start)), np.int16)
    tables = {t: lookup(list(t[0]), list(t[1])) for _, d, a in per_mcu for t in (d, a)}

    def peek(p: np.ndarray) -> np.ndarray:
        """At least 57 bits from bit p on, at the top of 64."""
        return window[np.minimum(p, limit) >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    top = np.uint64(48)
    for m in range(int(todo[0])):
        n = int(np.searchsorted(-todo, -m, side="left"))  # rows with more than m MCUs
        p = pos[:n]
        for b, (c, dc, ac) in enumerate(per_mcu):
            v = peek(p)
            hit = tables[dc][v >> top]
            cat, length = hit >> 5, hit & 31
            used = (length + cat).astype(np.uint64)
            v2 = v << length.astype(np.uint64)
            extra = ((v2 >> np.uint64(1)) >> (63 - cat).astype(np.uint64)).astype(np.int32)
            half = (1 << cat) >> 1
            pred[c][:n] += np.where(extra < half, extra - 2 * half + 1, extra)
            result[m, b, :n] = pred[c][:n]
            after_dc = tables[ac][(v << used) >> top]
            if not hit.all() or not after_dc.all():
                raise NotBaseline("no such code")
            p = p + (length + cat + (after_dc & 31) + (after_dc >> 5 & 15))
            rest = np.flatnonzero(after_dc >> 5)
            k = 2 + (after_dc[rest] >> 9)
            rest, k = rest[k < 64], k[k < 64]
            while len(rest):  # AC symbols are passed over
                more = tables[ac][peek(p[rest]) >> top]
                if not more.all():
                    raise NotBaseline("no such code")
                p[rest] += (more & 31) + (more >> 5 & 15)
                k = k + (more >> 9) + 1
                going = (more >> 5 != 0) & (k < 64)
                rest, k = rest[going], k[going]
        pos[:n] = p
    back = np.empty((len(start), *result.shape[:2]), np.int16)
    back[order] = result.transpose(2, 0, 1)
    out = []
    for i, total in enumerate(mcus):
        rows = back[first[i] : first[i + 1]]
        out.append(rows.reshape(-1, blocks)[:total] if restart else rows[0, :total])
    return out


def thumbnails(images: list[bytes]) -> list[tuple[int, int, np.ndarray] | None]:
    """Width, height and DC-only luminance thumbnail of each image (a sample for each 8 x 8 block of the first component)."""
    out: list = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    parsed: dict[int, dict] = {}
    for i, data in enumerate(images):
        try:
            x = parse(data)
            hs, vs = max(c[1] for c in x["frame"]), max(c[2] for c in x["frame"])
            if len(x["frame"]) == 1:
                x["frame"] = [(x["frame"][0][0], 1, 1, x["frame"][0][3])]
                hs = vs = 1
            x["across"], x["down"] = -(-x["width"] // (8 * hs)), -(-x["height"] // (8 * vs))
            x["blocks"] = [(c, x["dc"][x["chosen"][c] >> 4], x["ac"][x["chosen"][c] & 15]) for c, h, v, _ in x["frame"] for _ in range(h * v)]
            groups.setdefault((tuple(x["blocks"]), x["restart"]), []).append(i)
            parsed[i] = x
        except (NotBaseline, KeyError, IndexError, struct.error):
            continue
    for (blocks, restart), members in groups.items():
        for some in [members] if len(members) == 1 else [members, *[[m] for m in members]]:  # all together; alone where one of them is broken
            if all(out[m] is not None for m in some):
                continue
            try:
                values = _dc_values([images[m][parsed[m]["scan"] :] for m in some], list(blocks), [parsed[m]["across"] * parsed[m]["down"] for m in some], restart)
            except (NotBaseline, IndexError):
                continue
            for m, dc in zip(some, values, strict=True):
                x = parsed[m]
                _, h, v, q = x["frame"][0]
                luma = dc[:, : h * v].astype(np.int32).reshape(x["down"], x["across"], v, h).transpose(0, 2, 1, 3).reshape(x["down"] * v, x["across"] * h)
                scale = x["q"].get(q, 8)
                level = np.clip(np.rint(luma * scale / 8).astype(np.int64) + 128, 0, 255).astype(np.uint8)
                out[m] = (x["width"], x["height"], level[: -(-x["height"] // 8), : -(-x["width"] // 8)])
    return out


def thumbnail_hash(level: np.ndarray) -> str:
    """Average hash and difference hash of the thumbnail pooled to 8 x 8, and the crc32 of its samples."""
    rows, cols = (np.arange(8) * level.shape[0]) // 8, (np.arange(8) * level.shape[1]) // 8
    small = np.add.reduceat(np.add.reduceat(level.astype(np.int64), rows, axis=0), cols, axis=1).astype(float)
    area = np.diff(np.append(rows, level.shape[0]))[:, None] * np.diff(np.append(cols, level.shape[1]))[None, :]
    small /= np.maximum(area, 1)
    average, change = np.packbits(small > small.mean()), np.packbits(small > np.roll(small, 1, axis=1))
    return f"{average.tobytes().hex()}:{change.tobytes().hex()}:{zlib.crc32(np.ascontiguousarray(level)):08x}"


def encode(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the JPEG that stores each text; duplicate keys keep their rows."""
    kind = dict(df.dtypes)[key]

    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column(1))
        return {"key": batch.column(0), "n_bytes": [len(t) for t in texts], "media": encode_texts(texts)}

    return per_batch(df, [key, text], run, f"`{key}` {kind}, n_bytes bigint, media binary")


def features(df: DataFrame, key: str = "doc_id", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Digests and features of stored JPEGs: the payload read back, thumbnail size and hashes."""
    kind = dict(df.dtypes)[key]

    def run(batch: pa.RecordBatch) -> dict:
        images = [m or b"" for m in batch.column(2).to_pylist()]
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")}
        parts = [split_images(m) for m in images]
        found = iter(thumbnails([x for some in parts for x in some]))
        for size, image, some in zip(batch.column(1).to_pylist(), images, parts, strict=True):
            thumbs = [next(found) for _ in some]
            payload, thumb = None, thumbs[0] if None not in thumbs else None
            if thumb is not None:
                whole = size + (-size % UNIT or (0 if size else UNIT))
                payload = b"".join([x[2].tobytes()[: min(MOST, max(0, whole - i * MOST))] for i, x in enumerate(thumbs)])
            row = {
                "payload_bytes": payload and len(payload), "payload_sha256": payload and hashlib.sha256(payload).hexdigest(), "tail_crc32": payload and zlib.crc32(payload[-32:]),
                "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(),
                "feature": thumb and ";".join([f"{x[0]}x{x[1]}:{thumbnail_hash(x[2])}" for x in thumbs]), "width": thumb and thumb[0], "height": thumb and thumb[1],
            }
            for k, v in row.items():
                out[k].append(v)
        return {"key": batch.column(0), "n_bytes": batch.column(1), **out}

    return per_batch(df, [key, n_bytes, media], run, f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as JPEG and read back."""
    return features(encode(read_table(spark, sf_dir, "documents")))
