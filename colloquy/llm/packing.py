"""Best-fit packing by patterns and non-negative least squares.

Texts become token ids by a public tokenizer, each closed by id 1; only texts longer than a sequence are cut. The histogram of piece
lengths (at most ``LENGTH`` numbers, whatever the input's size) is all that reaches the driver. There, patterns of up to four lengths
are enumerated over coarse length bins, and non-negative least squares fits how often each pattern repeats so that all bins are used
up. Rounded down, the repeats take real lengths from the bins, largest first; the last place of each pattern takes the largest length
that still fits. Residual pieces go best-fit: longest first, to the fullest open sequence with room, else to a new one. All of this
works on counts of equal lengths and equal fillings, never on single pieces. The plan is a table of slots by length and rank, which
the pieces join.

A null or empty text is one piece that holds id 1 alone. A text of exactly the sequence's length is one piece. Repeated rows are
packed each on their own; pieces of one length take their places in the order of a hash, then of key and piece. An empty table gives no
rows. Columns of any name pass by; texts of any length are cut whole, none of their ids is left out.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut_lineage, per_batch, read_table

LENGTH, END, BINS, MOST_PARTS = 4096, 1, 64, 4
#: Distinct white-space-free strings whose ids a worker keeps.
CACHE = 900_000
#: Tasks that share the pieces of one length, and pieces of one length for each more.
SALTS, EACH_SALT, MOST_SALTS = 64, 1_000_000, 4096
#: Rows of the plan's table that are broadcast, at most.
BROADCAST = 500_000


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: ASCII punctuation without the apostrophe. Letters and then such marks: the vocabulary's rule splits a string just there.
MARKS = frozenset(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
PLAIN = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The letter under which a byte stands in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids of texts. The vocabulary's pieces never cross white space, so ids of white-space-free strings are joined.

    A new string of Latin letters and closing punctuation is put together from its parts, the letters going straight to the
    tokenizer's model; any other goes through the whole tokenizer."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def __getstate__(self):
        return {"path": self.path, "known": {}}

    def _plain(self, words: list[bytes], into: dict[bytes, bytes]) -> list[bytes]:
        """Ids of the words that are plain, into a table; the words that are not."""
        model, letters, others, later = tokenizer(self.path).model, byte_letters(), [], []
        known = self.known
        for w in words:
            # the usual cases first: ASCII letters, or those and one closing mark
            if w.isalpha():
                base, end = w.lower(), b""
            elif w[:-1].isalpha() and w[-1] in MARKS:
                base, end = w[:-1].lower(), w[-1:]
            else:
                m = PLAIN.fullmatch(w.decode())
                if not m or not m[1].isalpha() or max(m[1]) >= "\u0250" or "\u0130" in m[1]:
                    others.append(w)
                    continue
                base, end = m[1].lower().encode(), m[2].encode()
            ids = known.get(base) or into.get(base)
            if ids is None:
                name = base.decode() if base.isascii() else "".join([letters[b] for b in base])
                ids = into[base] = array("I", [t.id for t in model.tokenize(name)]).tobytes()
            if end:
                later.append((w, ids, end))
            else:
                into[w] = ids
        ends = [e for e in {x[2] for x in later} if e not in into]
        self._whole(ends, into)
        for w, ids, end in later:
            into[w] = ids + into[end]
        return others

    def _whole(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            for w, e in zip(some, tokenizer(self.path).encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                into[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.split() for t in texts]
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        full = len(known) >= CACHE
        once: dict[bytes, bytes] = {} if full else known
        self._whole(self._plain(new, once), once)
        if not full:
            return [b"".join(map(known.__getitem__, words)) for words in split]
        return [b"".join([once[w] if w in once else known[w] for w in words]) for words in split]


def tokenize(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids): ids of each text with the end id, cut at the sequence's length."""
    kind, encoder, last = dict(df.dtypes)[key], Encoder(path), np.array([end], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("at", "piece", "start", "length", "ids")}
        for at, ids in enumerate(encoder.encode(as_bytes(batch.column(1)))):
            ids += last
            for piece, start in enumerate(range(0, len(ids), 4 * length)):
                some = ids[start : start + 4 * length]
                for k, v in (("at", at), ("piece", piece), ("start", start // 4), ("length", len(some) // 4), ("ids", some)):
                    out[k].append(v)
        at = pa.array(out.pop("at"), pa.int64())
        return {"key": batch.column(0).take(at), **out}

    return per_batch(df, [key, text], run, f"key {kind}, piece int, start bigint, length bigint, ids binary")


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids instead of the ids."""
    return pieces.select("key", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))


def patterns(bins: int = BINS, parts: int = MOST_PARTS, least: int = 1) -> list[tuple[int, ...]]:
    """Falling tuples of up to parts bin numbers (least..bins) that sum to bins."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < parts:
            for b in range(min(left, most), least - 1, -1):
                extend((*head, b), left - b, b)

    extend((), bins, bins)
    return out


def fit_repeats(counts: np.ndarray, found: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Repeats x >= 0 that bring the bins used by the patterns closest to counts (least squares, by accelerated projected gradients).

    Bins are weighted by their length, so long pieces are used up first; small bins left over fill gaps later."""
    a = np.zeros((len(counts), len(found)))
    for j, p in enumerate(found):
        for b in p:
            a[b - 1, j] += 1
    weight = np.arange(1, len(counts) + 1)[:, None] ** 0.5
    scale = max(1.0, counts.max())
    wa, wb = weight * a, weight[:, 0] * counts / scale
    step = 1 / np.linalg.norm(wa, 2) ** 2
    x = z = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        y = np.maximum(0, z - step * (wa.T @ (wa @ z - wb)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = y + (t - 1) / t2 * (y - x), y, t2
    return x * scale


def plan(histogram: dict[int, int], length: int = LENGTH, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how many sequences have each: tuples of piece lengths that sum to length at most, and repeats."""
    left = np.zeros(length + 2, np.int64)
    for n, c in histogram.items():
        left[n] = c
    width = -(-length // bins)
    groups: list[tuple[tuple[int, ...], int]] = [((length,), int(left[length]))] if left[length] else []
    left[length] = 0
    coarse = np.array([left[b * width + 1 : min((b + 1) * width, length) + 1].sum() for b in range(bins)], float)
    opened: Counter[tuple[int, ...]] = Counter()

    def largest(most: int, least: int = 1) -> int:
        """The largest length up to most that is left."""
        some = np.flatnonzero(left[least : most + 1])
        return int(some[-1]) + least if len(some) else 0

    def exact(room: int, b: int) -> list[int] | None:
        """A length of bin b and the one that fills the room with it; no other pair will do. Bin 0: one length alone."""
        if not b:
            return [room] if left[room] > 0 else None
        low = (b - 1) * width + 1
        some = np.flatnonzero(left[low : min(b * width, room - 1) + 1]) + low
        other = room - some
        some = some[(left[other] > 0) & ((other != some) | (left[other] > 1))]
        return [int(some[-1]), room - int(some[-1])] if len(some) else None

    if coarse.any():
        found = patterns(bins)
        repeats = fit_repeats(coarse, found)
        for j in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[j])
            while todo > 0:
                taken: list[int] = []
                for b in found[j][:-2]:  # lengths of the bin, the largest first
                    n = largest(b * width, (b - 1) * width + 1)
                    if not n:
                        break
                    taken.append(n)
                    left[n] -= 1
                pair = exact(length - sum(taken), found[j][-2] if len(found[j]) > 1 else 0) if len(taken) == max(0, len(found[j]) - 2) else None
                for n in taken:
                    left[n] += 1
                if not pair:
                    break
                need = Counter([*taken, *pair])
                times = int(min(todo, *(left[n] // c for n, c in need.items())))
                if times <= 0:
                    break
                for n, c in need.items():
                    left[n] -= c * times
                opened[tuple(sorted(need.elements(), reverse=True))] += times
                todo -= times
    # residuals: best fit, longest first, over groups of equal fillings
    rooms: dict[int, Counter] = {}
    occupied = np.zeros(length + 1, bool)

    def put(filling: tuple[int, ...], times: int) -> None:
        room = length - sum(filling)
        rooms.setdefault(room, Counter())[filling] += times
        occupied[room] = True

    for filling, times in opened.items():
        put(filling, times)
    for n in range(length - 1, 0, -1):
        while left[n]:
            fit = np.flatnonzero(occupied[n:])
            if not len(fit):
                each = length // n
                times, rest = divmod(int(left[n]), each)
                if times:
                    put((n,) * each, times)
                if rest:
                    put((n,) * rest, 1)
                left[n] = 0
                break
            room = int(fit[0]) + n
            filling, times = rooms[room].popitem()
            if not rooms[room]:
                occupied[room] = False
            each = min(room // n, int(left[n]))
            used = min(times, int(left[n]) // each)
            if times > used:
                put(filling, times - used)
            put((*filling, *[n] * each), used)
            left[n] -= used * each
    return groups + [(filling, times) for room in sorted(rooms) for filling, times in rooms[room].items() if times]


def slots(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces a sequence, offset of the first): where the pieces of a length go, by rank."""
    out, used, sequence = [], Counter(), 0
    for filling, times in groups:
        offset = 0
        for n, c in Counter(filling).items():
            out.append((n, used[n], c * times, sequence, c, offset))
            used[n] += c * times
            offset += c * n
        sequence += times
    return out


def ranked(pieces: DataFrame, salts: int = SALTS) -> DataFrame:
    """Pieces with their rank among all of the same length, counted from 0.

    Pieces of one length are split by a hash into groups, ranked within, and shifted by the sizes of the groups before (a table of at
    most LENGTH x salts rows, which Spark broadcasts only while it is small), so a length that a third of all pieces share stands in many tasks."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece", "start", "ids_crc32"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("key", "piece", "ids_crc32")
    return salted.withColumn("r", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before")).drop("r", "before", "salt")


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Every piece with its sequence and its place there."""
    pieces = cut_lineage(digests(tokenize(df, path, key, text, length, end)))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    table = slots(plan(histogram, length))
    spark = df.sparkSession
    places = spark.createDataFrame(table or [(0, 0, 0, 0, 1, 0)], "length bigint, first bigint, n bigint, sequence bigint, each bigint, offset bigint")
    # slots number a few for each length: fillings are counted, not sequences
    if len(table) <= BROADCAST:
        places = F.broadcast(places)
    salts = min(MOST_SALTS, max(SALTS, max(histogram.values(), default=0) // EACH_SALT))
    joined = ranked(pieces, salts).join(places, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    inside = F.col("rank") - F.col("first")
    return joined.select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(inside / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("offset") + (inside % F.col("each")) * F.col("length")).cast("bigint").alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return pack(read_table(spark, sf_dir, "documents"), default_tokenizer())
