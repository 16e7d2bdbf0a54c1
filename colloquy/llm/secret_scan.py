"""Secret scans with corpus-wide ownership.

Each text is scanned for three base kinds (assignments, access keys, hexadecimal runs) and for further candidates in public key
formats. The value of every span is hashed; hashes are aggregated over the corpus into the distinct repositories and owners that
hold them. A value held by at most ``max_owners`` owners, in at most ``max_repositories`` repositories, looks live; one copied more
widely is an example. Base spans always stay; further candidates become spans (kind ``live``) only where they look live.

Null and empty texts have no spans (the base digest is that of the empty string). Repeated rows each get their own result but count
once for ownership. A null owner or repository counts as one owner or repository named by the empty string. Of spans that start at one
place the kinds go as listed; a candidate that overlaps a base span or an earlier candidate is dropped. Columns of any name pass; an
empty table gives no rows; very long texts are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut_lineage, per_batch, read_table, unused

MAX_OWNERS, MAX_REPOSITORIES, SALTS = 2, 8, 16

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "live")

# Fixed patterns of further public key formats.
FORMATS = re.compile(
    # a key's lines, from 20 characters on, and what is left over before its end; prose after the header is none
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:\s*+[A-Za-z0-9+/=]{20,}+)++(?:\s*+[A-Za-z0-9+/=]{1,19}+(?=\s*+-----END))?+(?:\s*+-----END (?:[A-Z]+ )*PRIVATE KEY-----)?+"
    r"|gh[pousr]_[A-Za-z0-9]{36,}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|(?<=://)[^\s:/@]{1,64}:[^\s:/@]{8,128}(?=@)"
)
LONG = re.compile(r"[A-Za-z0-9+/_-]{32,}")
WORDS = re.compile(rb"pass|secret|token|api", re.IGNORECASE)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def mixed(value: str) -> bool:
    """A long run that no prose and no path has: both cases, digits, and four bits a character."""
    return any(c.islower() for c in value) and any(c.isupper() for c in value) and sum(c.isdigit() for c in value) >= 4 and entropy(value) >= 4


def scan_text(data: bytes) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of base spans and further candidates (kind live), in code points."""
    text = data.decode()
    found = []
    if WORDS.search(data):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    more = [(m.start(), m.end(), m[0]) for m in FORMATS.finditer(text)] if b"-----BEGIN" in data or b"_" in data or b"-" in data or b"AIza" in data or b"eyJ" in data or b"://" in data else []
    more += [(m.start(), m.end(), m[0]) for m in LONG.finditer(text) if mixed(m[0])]
    taken: list[tuple[int, int]] = []  # stretches apart from one another, sorted
    for _, s, e, _ in sorted(found, key=lambda x: x[1]):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for s, e, value in more:
        at = bisect_left(taken, (s, e))
        if (at == len(taken) or e <= taken[at][0]) and (at == 0 or taken[at - 1][1] <= s):
            insort(taken, (s, e))
            found.append(("live", s, e, value))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def digest(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str | Column = "source", repository: str | Column = "source") -> DataFrame:
    """One row a document: base counts and digest, and its candidates with the hash of their values."""
    column = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    kind = dict(df.dtypes)[key]
    ready = df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("uid"), column(owner).alias("owner"), column(repository).alias("repository"), F.col(text).alias("text"))
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        every = [scan_text(t) for t in as_bytes(batch.column(4))]
        base = [[x for x in found if x[0] != "live"] for found in every]
        return {
            "key": batch.column(0), "uid": batch.column(1), "owner": batch.column(2), "repository": batch.column(3),
            **{f"n_{k}": [sum(x[0] == k for x in b) for b in base] for k in KINDS[:3]},
            "base_sha256": [hashlib.sha256(digest(b).encode()).hexdigest() for b in base],
            "found": pa.array([[{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for k, s, e, v in found] for found in every], type=pa.list_(struct)),
        }

    schema = f"key {kind}, uid bigint, owner string, repository string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<struct<kind:string,start:bigint,end:bigint,hash:string>>"
    return per_batch(ready, ["key", "uid", "owner", "repository", "text"], run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners): distinct holders of each value; copies within one holder shrink before they are dealt out."""
    held = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("copies"))
    return held.groupBy("hash", "owner").agg(F.count("*").alias("repositories")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str | Column = "source", repository: str | Column = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per row of df: base columns, all spans, and how many of them look live or are widely copied examples."""
    scanned = cut_lineage(scan(df, key, text, owner, repository))  # texts are read once; what is found is small
    candidates = scanned.where(F.size("found") > 0).select("uid", "owner", "repository", F.explode("found").alias("x")).select("uid", "owner", "repository", "x.*")
    # a value that a third of all rows hold meets its counts in 16 tasks
    counts = ownership(candidates).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = candidates.withColumn("salt", (F.col("uid") % SALTS).cast("int")).join(counts, ["hash", "salt"])
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    rank = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(4), strict=True) for x in pair])
    kept = judged.where((F.col("kind") != "live") | live)
    spans = kept.groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))).alias("spans"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_example"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"),
    )
    joined = scanned.select("uid", F.col("key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256").join(spans, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select(
        key, "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","), F.lit("")).alias("spans"),
        zero("n_live"), zero("n_example"), zero("most_owners"), zero("most_repositories"),
    )


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str | Column = "source", repository: str | Column = "source") -> DataFrame:
    """df with every span of ``text`` replaced by ``[kind]``; n_chars, where df has it, follows. Rows and other columns stay."""
    name = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")).cast("binary")
    row, spans = unused(df, "row"), unused(df, "spans")
    # 128 bits of all that spans depend on: rows that share them share their spans
    parts = [F.md5(name(c)) for c in (F.col(key), owner, repository, F.col(text))]
    ready = df.withColumn(row, F.unhex(F.md5(F.concat(*parts).cast("binary"))))
    found = find_secrets(ready, row, text, owner, repository).where(F.col("spans") != "").select(row, F.col("spans").alias(spans)).dropDuplicates([row])
    joined = ready.join(found, row, "left")
    kind = dict(df.dtypes)[text]
    parts = F.transform(F.split(spans, ","), lambda s: F.struct(F.split(s, ":")[0].alias("k"), F.split(s, ":")[1].cast("int").alias("s"), F.split(s, ":")[2].cast("int").alias("e")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        parts, start,
        lambda a, x: F.when(x["s"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], x["e"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, x["s"] - a["at"]), F.lit("["), x["k"], F.lit("]")).alias("out"), x["e"].alias("at"))),
        lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)),
    )
    clean = joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(done).cast(kind))
    if "n_chars" in df.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(dict(df.dtypes)["n_chars"]))
    return clean.select(*[F.col(c) for c in df.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a document's source is the owner, its source and language the repository."""
    docs = read_table(spark, sf_dir, "documents")
    return find_secrets(docs, repository=F.concat_ws("/", "source", "lang"))
