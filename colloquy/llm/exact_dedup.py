"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are the same after lower-casing A-Z alone. Each task first gathers what is equal within a window of its rows,
so copies shrink before they are dealt out: a window gives one entry for each text it holds, with the rows that hold it. An entry's key
is the beginning of its text's SHA-256. The index's directory starts with one bucket for all keys; a bucket that holds more bytes than
its capacity is split on its next bit, and where no bit is left the directory doubles. Each bucket is a range of keys with an owner task,
which reads its entries sorted by key, chains texts whose keys collide, and tells an entry's class by comparing bytes. What owners find
is written to the shared folder: every entry with its class, and the text of each class once. Sizes and the row that stays are sums
over entries.

A bucket that one key overfills can't be split: its entries, one a window, stream through the owner, which holds one text of each chain.
The rows of such a class are dealt out in blocks. Null texts count as empty, and empty texts are equal. Of rows with equal texts that of
the largest key stays (null is smallest); of repeated rows with that key, one. An empty table gives no rows; texts of any length are
compared whole; columns of any name pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut_lineage, portions, read_table, release, unused

#: Rows and bytes of a window; bytes of a bucket, most bits of the directory, and rows of a class that are dealt out together.
WINDOW_ROWS, WINDOW_BYTES = 4096, 8 << 20
CAPACITY, MOST_DEPTH, BLOCK_ROWS = 16 << 20, 16, 4096
KEY_BITS = 64


@dataclass
class Directory:
    """slots: the bucket of each beginning of a key, of ``depth`` bits; buckets are numbered by their range of keys."""

    depth: int
    slots: np.ndarray

    def owners(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(keys), np.int64)

    @property
    def buckets(self) -> int:
        return int(self.slots[-1]) + 1


def grow_directory(held: np.ndarray, capacity: int) -> Directory:
    """The directory after all splits; held: bytes by the first bits of their keys (a power of two of them, the most a directory may tell apart)."""
    most = len(held).bit_length() - 1
    before = np.concatenate([[0], np.cumsum(held)])
    slots, depth, buckets, todo = np.zeros(1, np.int64), 0, 1, [(0, 0)]
    while todo:
        prefix, local = todo.pop()
        if local == most or before[(prefix + 1) << (most - local)] - before[prefix << (most - local)] <= capacity:
            continue
        if local == depth:
            slots, depth = np.repeat(slots, 2), depth + 1
        at, half = prefix << (depth - local), 1 << (depth - local - 1)
        slots[at + half : at + 2 * half] = buckets
        buckets += 1
        todo += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
    return Directory(depth, np.concatenate([[0], np.cumsum(np.diff(slots) != 0)]))


def _key(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "big") & ((1 << 64) - (1 << (64 - bits)))


def _windows(batches: Iterator[pa.RecordBatch], rows: int, most_bytes: int) -> Iterator[dict]:
    """Each window's texts, normalised, with the rows that hold them: text to (key of the document, number of the row)s."""
    held: dict[bytes, list] = {}
    n = size = 0
    for batch in batches:
        for some in portions(batch):
            ids, uids = some.column(0).to_pylist(), some.column(1).to_pylist()
            for i, uid, text in zip(ids, uids, as_bytes(some.column(2)), strict=True):
                low = text.lower()  # of bytes: A-Z alone
                if low not in held:
                    size += len(low)
                    held[low] = []
                held[low].append((i, uid))
                n += 1
                if n >= rows or size >= most_bytes:
                    yield held
                    held, n, size = {}, 0, 0
    if held:
        yield held


def _prepared(df: DataFrame, key: str, text: str, uid: str | None) -> DataFrame:
    return df.select(F.col(key).alias("id"), (F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), F.col(text).alias("text"))


def make_directory(df: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, depth: int = MOST_DEPTH, bits: int = KEY_BITS, rows: int = WINDOW_ROWS) -> Directory:
    """The directory for the entries that df's windows give, from their bytes by the beginnings of their keys (at most 2 ** depth sums).

    Capacity grows with what there is beyond 2 ** (depth - 1) full buckets, so the directory stays within that many bits."""

    def run(batches):
        for held in _windows(batches, rows, WINDOW_BYTES):
            at = np.array([_key(hashlib.sha256(t).digest(), bits) >> (64 - depth) for t in held], np.int64)
            sizes = np.fromiter(map(len, held), np.int64, len(held)) + 64 * np.fromiter(map(len, held.values()), np.int64, len(held))
            some, place = np.unique(at, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.bincount(place, sizes, len(some)).astype(np.int64))], names=["prefix", "bytes"])

    sums = _prepared(df, key, text, None).mapInArrow(run, "prefix bigint, bytes bigint").groupBy("prefix").agg(F.sum("bytes").alias("bytes")).toArrow()
    held = np.zeros(1 << depth, np.int64)
    held[sums["prefix"].to_numpy()] = sums["bytes"].to_numpy()
    return grow_directory(held, max(capacity, int(held.sum()) >> (depth - 1)))


def index_texts(df: DataFrame, directory: Directory, key: str = "doc_id", text: str = "text", *, uid: str | None = None, bits: int = KEY_BITS, rows: int = WINDOW_ROWS) -> DataFrame:
    """The index as a table in the shared folder: (hash, chain, block, digest, members, body), one row for each entry.

    hash and chain name a class; body, the normalised text, stands in the first entry of each; block parts a class of very many rows."""
    kind = dict(df.dtypes)[key]
    entry = f"hash bigint, digest binary, members array<struct<id:{kind},uid:bigint>>, body binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    dealt_schema, chained_schema = (to_arrow_schema(StructType.fromDDL(s)) for s in (f"owner int, {entry}", f"chain int, block bigint, {entry}"))

    def table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def deal(batches):
        for held in _windows(batches, rows, WINDOW_BYTES):
            digests = [hashlib.sha256(t).digest() for t in held]
            keys = np.array([_key(d, bits) for d in digests], np.uint64).view(np.int64)
            members = [[{"id": i, "uid": u} for i, u in m] for m in held.values()]
            yield table([directory.owners(keys), keys, digests, members, list(held)], dealt_schema)

    def own(batches):
        at, chain = None, []  # the key at hand; its texts, each with the rows seen of it
        for batch in batches:
            for some in portions(batch):
                keys, digests, members, bodies = (some.column(i).to_pylist() for i in range(1, 5))
                chains, blocks, heads = [], [], []
                for k, m, body in zip(keys, members, bodies, strict=True):
                    if k != at:
                        at, chain = k, []
                    place = next((i for i, (known, _) in enumerate(chain) if known == body), len(chain))
                    heads.append(body if place == len(chain) else None)
                    if place == len(chain):
                        chain.append([body, 0])
                    chains.append(place)
                    blocks.append(chain[place][1] // BLOCK_ROWS)
                    chain[place][1] += len(m)
                yield table([chains, blocks, keys, digests, members, heads], chained_schema)

    dealt = _prepared(df, key, text, uid).mapInArrow(deal, f"owner int, {entry}")
    ranges = dealt.repartitionById(directory.buckets, "owner").sortWithinPartitions("hash")
    return cut_lineage(ranges.mapInArrow(own, f"chain int, block bigint, {entry}"))


def classes(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, uid, keep_id, group_size, kept, text_sha256) of every row of the table that was indexed."""
    entries = index.select("hash", "chain", "block", "digest", "members")  # no text
    sums = entries.groupBy("hash", "chain").agg(F.sum(F.size("members")).alias("group_size"), F.max(F.array_max("members")).alias("best"), F.max("block").alias("last"))
    every = sums.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    found = entries.join(every, ["hash", "chain", "block"]).select("digest", "group_size", "best", F.explode("members").alias("m"))
    return found.select(F.col("m.id").alias(key), F.col("m.uid").alias("uid"), F.col("best.id").alias("keep_id"), "group_size", (F.col("m.uid") == F.col("best.uid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def find_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = CAPACITY, bits: int = KEY_BITS, rows: int = WINDOW_ROWS) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of df: which row of those with its text stays, and how many there are."""
    directory = make_directory(df, key, text, capacity=capacity, bits=bits, rows=rows)
    return classes(index_texts(df, directory, key, text, bits=bits, rows=rows), key).drop("uid")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all its columns as they are."""
    row = unused(df, "row")
    numbered = cut_lineage(df.withColumn(row, F.monotonically_increasing_id()))
    index = index_texts(numbered, make_directory(numbered, key, text), key, text, uid=row)
    kept = cut_lineage(classes(index, key).where("kept").select(F.col("uid").alias(row)))
    release(index)
    return numbered.join(kept, row, "left_semi").select(*df.columns)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return find_duplicates(read_table(spark, sf_dir, "documents"))


SQL = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""
