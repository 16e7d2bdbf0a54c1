"""Stored tables, merged on read.

<path>/<table>/v=<number>-<unique>/bucket=<b> holds the rows one run has added to a bucket. A run writes what changes and nothing else:
new rows, and in the table of tombstones the sessions whose older rows are dead. A row counts unless a tombstone of its session is of a
later version. <path>/_log/<number> is a manifest: the versions that make up each bucket of each table, and the directory of buckets.

Rows of a session stand in one bucket of every table, found by the last bits of the session's hash through an extendible directory:
compact() rewrites a bucket when what was added to it weighs as much as its largest version, and splits one that has outgrown its
size, doubling the directory where no bit is left. Manifests are created under the next number, which only one of several writers can do;
a writer that finds others before it tries again on top of them, unless they touched a bucket that it has touched too. Readers of a
manifest see its versions until vacuum() drops both.

Joins of what grows with the store ask for a merge: a table that Spark takes to be small enough to broadcast would pass through the driver,
several in each run, as large as the session's threshold allows.

Exclusive creation: on local folders by a hard link, elsewhere by a rename that doesn't overwrite (atomic on HDFS and file systems like it;
an object store needs one whose renames are, or a committer that gives it conditional writes)."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that names a row's session, for tables in buckets; rows of other tables stand in one bucket.
KEYS = {"sessions": "id", "messages": "session_id", "vectors": "session_id", "failures": "session_id", "claims": "session_id", "codes": "session_id", "tombstones": "session_id"}
#: Tables in one bucket whose rows tombstones kill as well, kept as a table of their own until all segments are younger.
INDEXED, UNINDEXED, ALL = "postings", "unindexed", "all"
#: Bytes at which a bucket splits, versions of a bucket before they are gathered, and bits of the directory at most.
BUCKET_BYTES, MOST_VERSIONS, MOST_DEPTH = 128 << 20, 16, 16

TOMBSTONES = "session_id string"


class Conflict(RuntimeError):
    """Another writer has changed what this one has read or written."""


def number_of(version: str) -> int:
    """The number of the manifest that first names a version."""
    return int(version[2:].split("-")[0])


class Store:
    def __init__(self, spark: SparkSession, path: str, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.path, self.bucket_bytes = spark, path.rstrip("/"), bucket_bytes

    # Files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _create(self, target: str, text: str) -> bool:
        """Write a file that isn't there yet; False if another is faster. Nobody sees it half written."""
        aside = f"{target}.{uuid.uuid4().hex}"
        fs, p = self._fs(aside)
        stream = fs.create(p, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":
                at = [jvm.java.nio.file.Paths.get(jvm.java.net.URI.create("file://" + self._fs(x)[1].toUri().getRawPath())) for x in (target, aside)]
                jvm.java.nio.file.Files.createLink(*at)
                self._delete(aside)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(p, self._fs(target)[1], self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
            return True
        except Exception as e:
            if not re.search("FileAlreadyExists", str(e)):
                raise
            self._delete(aside)
            return False

    # Manifests

    def numbers(self) -> list[int]:
        return [int(n) for n in self._names(f"{self.path}/_log") if n.isdigit()]

    def manifest(self, number: int | None = None) -> dict:
        """The given manifest, else the last; an empty one before the first write."""
        number = number if number is not None else max(self.numbers(), default=0)
        if not number:
            return {"number": 0, "slots": [0], "local": {"0": 0}, "tables": {}}
        fs, p = self._fs(f"{self.path}/_log/{number:020d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, base: dict, add: list[tuple], remove: list[tuple] = (), directory: dict | None = None, touched: set[str] | None = None, still: tuple = ()) -> dict:
        """The next manifest: versions (table, bucket, version, bytes) added and (table, bucket, version) removed, buckets split.

        Buckets in ``touched`` and tables in ``still`` must stand as in ``base``; others may have changed since. A new directory allows no change at all."""
        touched = touched or set()
        while True:
            now = self.manifest()
            if now["number"] != base["number"]:
                changed = {b for t in {*base["tables"], *now["tables"]} if t in KEYS for b in {*base["tables"].get(t, {}), *now["tables"].get(t, {})} if base["tables"].get(t, {}).get(b) != now["tables"].get(t, {}).get(b)}
                if directory or base["slots"] != now["slots"] or changed & touched or any(base["tables"].get(t) != now["tables"].get(t) for t in still):
                    raise Conflict(f"version {now['number']} has changed what this run, on top of {base['number']}, has touched")
            after = {"number": now["number"] + 1, "slots": now["slots"], "local": now["local"]} | (directory or {}) | {"tables": {t: {b: [list(v) for v in vs] for b, vs in parts.items()} for t, parts in now["tables"].items()}}
            for t, b, version in remove:
                held = after["tables"].get(t, {}).get(b, [])
                if not any(v[0] == version for v in held):
                    raise Conflict(f"{t}/{version} is gone")
                after["tables"][t][b] = [v for v in held if v[0] != version]
                if not after["tables"][t][b]:
                    del after["tables"][t][b]
            for t, b, version, size in add:
                after["tables"].setdefault(t, {}).setdefault(b, []).append([version, size])
            self._fs(f"{self.path}/_log")[0].mkdirs(self._fs(f"{self.path}/_log")[1])
            if self._create(f"{self.path}/_log/{after['number']:020d}", json.dumps(after)):
                return after

    # Reading

    def _load(self, table: str, schema: str, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        """Rows as they are written, with their version's number."""
        paths = [f"{self.path}/{table}/{v}/bucket={b}" for b, versions in sorted(manifest["tables"].get(table, {}).items()) if buckets is None or b in buckets for v, _ in versions]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, _version bigint")
        return self.spark.read.schema(schema).parquet(*paths).withColumn("_version", F.regexp_extract("_metadata.file_path", r"/v=(\d+)-", 1).cast("bigint"))

    def killing(self, table: str, manifest: dict, buckets: set[str] | None = None, tombstones: str = "tombstones") -> dict:
        """The manifest with those tombstones alone that can kill a row of the table: the ones younger than its oldest rows in their bucket."""
        held, out = manifest["tables"].get(table, {}), {}
        for b, versions in manifest["tables"].get(tombstones, {}).items():
            oldest = min((number_of(v) for v, _ in held.get(b, [])), default=None)
            younger = [v for v in versions if number_of(v[0]) > oldest] if oldest is not None and (buckets is None or b in buckets) else []
            out |= {b: younger} if younger else {}
        return manifest | {"tables": manifest["tables"] | {tombstones: out}}

    def live(self, rows: DataFrame, key: str, manifest: dict, buckets: set[str] | None = None, table: str = "tombstones") -> DataFrame:
        """Rows, with their version, without those that a later tombstone of their session kills."""
        if not any(buckets is None or b in buckets for b in manifest["tables"].get(table, {})):
            return rows.drop("_version")
        dead = self._load(table, TOMBSTONES, manifest, buckets).groupBy(F.col("session_id").alias("_dead")).agg(F.max("_version").alias("_killed"))
        return rows.join(dead.hint("merge"), F.col(key) == F.col("_dead"), "left").where(F.coalesce(F.col("_version") >= F.col("_killed"), F.lit(True))).drop("_version", "_dead", "_killed")

    def read(self, table: str, schema: str, manifest: dict | None = None, buckets: set[str] | None = None) -> DataFrame:
        """A table's rows, of all buckets or some; none before the first write."""
        manifest = manifest or self.manifest()
        key = KEYS.get(table)
        if not key:
            return self._load(table, schema, manifest).drop("_version")
        names = [f.name for f in self.spark.createDataFrame([], schema).schema]
        stored = schema if key in names else f"{schema}, {key} string"
        return self.live(self._load(table, stored, manifest, buckets), key, self.killing(table, manifest, buckets), buckets).select(*names)

    # Writing

    def bucket(self, session: str | Column, directory: dict) -> Column:
        """The bucket of a session's rows in all tables."""
        if len(directory["slots"]) == 1:
            return F.lit(str(directory["slots"][0]))
        place = F.pmod(F.xxhash64(session), F.lit(len(directory["slots"]))).cast("int")
        return F.get(F.split(F.lit(",".join(map(str, directory["slots"]))), ","), place)

    def put(self, table: str, rows: DataFrame, base: dict, directory: dict | None = None) -> list[tuple]:
        """Rows as a version that no manifest names yet: (table, bucket, version, bytes) of its buckets."""
        version = f"v={base['number'] + 1:020d}-{uuid.uuid4().hex}"
        at = f"{self.path}/{table}/{version}"
        if table in KEYS:
            key = KEYS[table]
            placed = rows.withColumn("bucket", self.bucket(key, directory or base)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
            placed.write.partitionBy("bucket").parquet(at)
        else:
            rows.write.parquet(f"{at}/bucket={ALL}")
        fs, _ = self._fs(at)
        return [(table, n.split("=")[1], version, int(fs.getContentSummary(self._fs(f"{at}/{n}")[1]).getLength())) for n in self._names(at) if n.startswith("bucket=")]

    def append(self, tables: dict[str, DataFrame], base: dict | None = None, touched: set[str] | None = None) -> dict:
        """Rows added to tables, in one manifest."""
        base = base or self.manifest()
        add = [v for name, rows in tables.items() for v in self.put(name, rows, base)]
        return self.commit(base, add, touched=touched if touched is not None else {b for t, b, *_ in add if t in KEYS})

    def aside(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """Rows written once under the store's path for the length of a run, and where."""
        path = f"{self.path}/_staging/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def discard(self, path: str) -> None:
        self._delete(path)

    # Upkeep

    def overgrown(self, manifest: dict) -> dict[str, int]:
        """Buckets to rewrite, and into how many parts (a power of two): those whose further versions weigh as much as the largest, that
        have too many, or that have outgrown their size. The size grows with all bytes once the directory has no bits left to give."""
        sizes: dict[str, dict[str, list[int]]] = {}
        for t in KEYS:
            for b, versions in manifest["tables"].get(t, {}).items():
                sizes.setdefault(b, {})[t] = [v[1] for v in versions]
        most = max(self.bucket_bytes, 2 * sum(sum(s) for x in sizes.values() for s in x.values()) >> MOST_DEPTH)
        out = {}
        for b, tables in sizes.items():
            total, bits = sum(map(sum, tables.values())), 0
            while total >> bits > most and manifest["local"][b] + bits < MOST_DEPTH:
                bits += 1
            heavy = any(len(s) > 1 and sum(s) >= 2 * max(s) or len(s) > MOST_VERSIONS for s in tables.values())
            if bits or heavy:
                out[b] = 1 << bits
        return out

    def split(self, manifest: dict, parts: dict[str, int]) -> dict:
        """The directory (slots and local depths) with buckets split into so many parts."""
        slots, local = list(manifest["slots"]), dict(manifest["local"])
        for b, n in parts.items():
            todo = [b]
            for _ in range(n.bit_length() - 1):
                for one in list(todo):
                    if 1 << local[one] == len(slots):
                        slots = slots + slots  # no bit left: the directory doubles
                    new, bit = max(map(int, local)) + 1, 1 << local[one]
                    slots = [new if s == int(one) and i & bit else s for i, s in enumerate(slots)]
                    local[one] = local[str(new)] = local[one] + 1
                    todo.append(str(new))
        return {"slots": slots, "local": local}

    def compact(self, schemas: dict[str, str]) -> dict:
        """Rewrite buckets that are due, split those that are too large; their tombstones have then done their work. schemas: as they are stored."""
        base = self.manifest()
        parts = self.overgrown(base)
        due, directory, add = set(parts), self.split(base, parts), []
        remove = [(t, b, v) for t in KEYS for b, versions in base["tables"].get(t, {}).items() if b in due for v, _ in versions]
        for table, schema in schemas.items():
            held = base["tables"].get(table, {})
            if table in KEYS and due & set(held):
                add += self.put(table, self.read(table, schema, base, due), base, directory)
            elif table not in KEYS and len(held.get(ALL, [])) > MOST_VERSIONS:
                add += self.put(table, self.read(table, schema, base).coalesce(1), base)
                remove += [(table, ALL, v) for v, _ in held[ALL]]
        if not remove:
            return base
        return self.commit(base, add, remove, directory if directory["slots"] != base["slots"] else None, touched=due)

    def vacuum(self, keep: int = 3, age_ms: int = 86_400_000) -> None:
        """Drop all but the last manifests, versions that none of those names, and what dead runs have left; nothing younger than ``age_ms``."""
        numbers = sorted(self.numbers())
        kept = {(t, v[0]) for n in numbers[-keep:] for t, parts in self.manifest(n)["tables"].items() for vs in parts.values() for v in vs}
        now = int(time.time() * 1000)

        def old(path: str) -> bool:
            fs, p = self._fs(path)
            return fs.getFileStatus(p).getModificationTime() <= now - age_ms

        for n in numbers[:-keep]:
            if old(f"{self.path}/_log/{n:020d}"):
                self._delete(f"{self.path}/_log/{n:020d}")
        left = {(t, v[0]) for n in self.numbers() for t, parts in self.manifest(n)["tables"].items() for vs in parts.values() for v in vs}
        for table in self._names(self.path):
            for name in self._names(f"{self.path}/{table}") if table != "_log" else []:
                if (table, name) not in kept | left and old(f"{self.path}/{table}/{name}"):
                    self._delete(f"{self.path}/{table}/{name}")
