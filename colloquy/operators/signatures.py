"""Substring search by trigram signatures: chunks of stored messages that cannot hold a needle aren't read.

A chunk is the messages of one version of a bucket whose session ids begin with the same digits, as many digits as make chunks of about a
megabyte; rows of a version are sorted by session, so a filter on those digits reaches the files' row groups. Its signature is a bitmap of
the trigrams of its sanitised lines in lower case, by their CRC. A chunk whose bitmap lacks one of the needle's trigrams holds no line
with the needle; what is left goes through the exact line test. Versions are immutable: ``sign`` adds signatures for those that have
none yet, and others are read whole until then.

Needles of fewer than three characters have no trigrams, and for needles found in very many chunks a list of chunks saves nothing: both
are looked for in all messages. A session of very many rows is one chunk, whose bitmap may be full: it is always read. Null texts are in no
chunk's signature and in no result; an empty needle finds nothing."""

from __future__ import annotations

import math
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import sanitize
from colloquy.operators.filters import in_session_search
from colloquy.operators.store import ALL, Store

#: Bytes of files that a chunk comes from, bits of a signature (fixed by Spark's bitmaps), and chunks up to which a search names them one by one.
CHUNK_BYTES, BITS, MOST_NAMED = 1 << 20, 32_768, 200
SIGNATURES = "version string, bucket string, prefix string, signature binary"
MESSAGES = "message_id bigint, session_id string, role string, content string, timestamp bigint, seq int"
FOUND = ["session_id", "seq", "role"]


def trigrams(content: str = "content") -> Column:
    """Distinct trigrams of the sanitised lines in lower case; none reaches over a line's end."""
    lines = F.array_join(F.transform(F.split(content, "\n"), lambda line: F.lower(sanitize(line))), "\n")
    return F.array_distinct(F.regexp_extract_all(lines, F.lit(r"(?=([^\n]{3}))[^\n]"), F.lit(1)))


def bits_of(needle: str) -> list[int]:
    """Positions that a signature must have for a line with the needle."""
    text = needle.lower()
    return sorted({zlib.crc32(text[i : i + 3].encode()) % BITS for i in range(len(text) - 2)})


def holds(signature: str, bits: list[int]) -> Column:
    """Whether a bitmap has all of the bits."""
    byte = lambda n: F.conv(F.hex(F.substring(signature, n + 1, 1)), 16, 10).cast("bigint")
    return reduce(lambda a, b: a & b, [F.getbit(byte(n // 8), F.lit(n % 8)) == 1 for n in bits], F.lit(True))


def _versions(manifest: dict) -> dict[tuple[str, str], int]:
    """(version, bucket) of messages to their bytes."""
    return {(v, b): size for b, versions in manifest["tables"].get("messages", {}).items() for v, size in versions}


def _only(manifest: dict, some) -> dict:
    """The manifest with these (version, bucket) of messages alone."""
    parts: dict[str, list] = {}
    for v, b in some:
        parts.setdefault(b, []).append([v, 0])
    return manifest | {"tables": {"messages": parts}}


def _live(store: Store, manifest: dict, some) -> DataFrame:
    """Messages of some versions that no tombstone kills."""
    only, buckets = _only(manifest, some), {b for _, b in some}
    return store.live(store._load("messages", MESSAGES, only), "session_id", store.killing("messages", manifest | {"tables": manifest["tables"] | only["tables"]}, buckets), buckets)


def _signed(store: Store, manifest: dict) -> set[tuple[str, str]]:
    rows = store.read("signatures", SIGNATURES, manifest).select("version", "bucket").distinct().collect()  # as many as a manifest names
    return {(r["version"], r["bucket"]) for r in rows}


def sign(store: Store, chunk_bytes: int = CHUNK_BYTES) -> dict:
    """Signatures for versions of messages that have none, in one pass over those; signatures of versions that are gone are dropped when they are most."""
    base = store.manifest()
    have, signed = _versions(base), _signed(store, base)
    todo, add, remove = {k: n for k, n in have.items() if k not in signed}, [], []
    by_digits: dict[int, list] = {}
    for key, size in todo.items():
        by_digits.setdefault(max(0, math.ceil(math.log(max(size, 1) / chunk_bytes, 16))), []).append(key)
    parts = []
    for digits, some in by_digits.items():  # as many as sizes have orders of magnitude
        paths = [f"{store.path}/messages/{v}/bucket={b}" for v, b in some]
        rows = store.spark.read.schema(MESSAGES).parquet(*paths)
        name = lambda group: F.regexp_extract("_metadata.file_path", r"/(v=[^/]+)/bucket=([^/]+)/", group)
        grams = rows.select(name(1).alias("version"), name(2).alias("bucket"), F.substring("session_id", 1, digits).alias("prefix"), F.explode(trigrams()).alias("gram"))
        place = F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(BITS))
        parts.append(grams.groupBy("version", "bucket", "prefix").agg(F.bitmap_construct_agg(place).alias("signature")))
    old = [v for v, _ in base["tables"].get("signatures", {}).get(ALL, [])]
    if len(signed - set(have)) > len(signed) / 2:
        live = store.spark.createDataFrame(sorted(signed & set(have)), "version string, bucket string")
        parts.append(store.read("signatures", SIGNATURES, base).join(live, ["version", "bucket"], "left_semi"))
        remove = [("signatures", ALL, v) for v in old]
    if not parts:
        return base
    # versions whose messages have no trigrams at all are signed too, by an empty bitmap of the whole version
    bare = store.spark.createDataFrame([(v, b, "", bytearray(BITS // 8)) for v, b in todo], SIGNATURES)
    add = store.put("signatures", reduce(DataFrame.unionByName, [*parts, bare]), base)
    return store.commit(base, add, remove)


def _candidates(store: Store, manifest: dict, needle: str) -> DataFrame:
    """Chunks of the manifest's versions that can hold the needle."""
    have = store.spark.createDataFrame(sorted(_versions(manifest)), "version string, bucket string")
    return store.read("signatures", SIGNATURES, manifest).where(holds("signature", bits_of(needle))).join(have, ["version", "bucket"], "left_semi").select("version", "bucket", "prefix")


def search_lines(store: Store, needle: str, manifest: dict | None = None) -> DataFrame:
    """filters.in_session_search over the stored messages, the same rows."""
    manifest = manifest or store.manifest()
    have = _versions(manifest)
    named = _candidates(store, manifest, needle).limit(MOST_NAMED + 1).collect() if bits_of(needle) and have else None
    if named is None or len(named) > MOST_NAMED:
        return in_session_search(store.read("messages", MESSAGES, manifest), needle)
    at: dict[tuple, set] = {}
    for r in named:
        at.setdefault((r["version"], r["bucket"]), set()).add(r["prefix"])
    groups: dict[tuple, list] = {}  # versions with the same chunks to read are read together
    for key, prefixes in at.items():
        groups.setdefault(tuple(sorted(prefixes)), []).append(key)
    whole = sorted(set(have) - _signed(store, manifest))
    parts = [in_session_search(_live(store, manifest, whole), needle)] if whole else []
    for prefixes, some in groups.items():
        chunk = reduce(lambda a, b: a | b, [F.startswith("session_id", F.lit(p)) for p in prefixes])
        parts.append(in_session_search(_live(store, manifest, some).where(chunk), needle))
    if not parts:
        return store.spark.createDataFrame([], MESSAGES).select(*FOUND)
    return reduce(DataFrame.unionByName, parts)


def chunks_read(store: Store, needle: str) -> DataFrame:
    """One row: how many chunks have signatures, and how many of them a search for the needle reads."""
    manifest = store.manifest()
    have = store.spark.createDataFrame(sorted(_versions(manifest)), "version string, bucket string")
    rows = store.read("signatures", SIGNATURES, manifest).join(have, ["version", "bucket"], "left_semi")
    grams = F.bitmap_count("signature") > 0
    return rows.where(grams).agg(F.count("*").alias("chunks"), F.count_if(holds("signature", bits_of(needle))).alias("chunks_read"))
