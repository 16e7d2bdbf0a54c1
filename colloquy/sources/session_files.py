"""Session files without a list of them on the driver: a data source that lists (and peeks into) them in tasks, and reading by lines.

A task lists the part of a folder that its share of the folder's entries makes up; filters on time and path reach it, so a file that
they leave out isn't peeked into. Lines are read in ranges of bytes, some megabytes at a time, so a log of any size is read by many
tasks and held by none."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Tasks that list, bytes of a range of lines, bytes read at once, and lines of a batch.
TASKS, RANGE, CHUNK, LINES = 8, 64 << 20, 1 << 20, 4096
#: How far a stream stays behind the clock.
LAG_MS = 2_000
SCHEMA = "path string, modified_ms bigint, size bigint, head string"


def file_system(path: str):
    """(file system, path in it, what stands before a path's name in Spark's listings)."""
    from pyarrow import fs

    if path.startswith("file:") or ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/"), "file:"
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else path.split("://")[0] + "://"


@dataclass
class Share(InputPartition):
    number: int


class Reader(DataSourceReader):
    KINDS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.recursive, self.peek, self.tasks = options.get("recursive", "false").lower() == "true", int(options.get("peek", 0)), int(options.get("tasks", TASKS))
        self.filters: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        """Filters on time, size and path are kept here; the rest goes back."""
        for f in filters:
            if type(f) in self.KINDS and f.attribute in (("modified_ms",), ("size",), ("path",)):
                self.filters.append((type(f).__name__, f.attribute[0], list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[Share]:
        return [Share(i) for i in range(self.tasks)]

    def _walk(self, system, at: str, parts: list[str], share: int | None) -> Iterator:
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if share is not None and zlib.crc32(info.base_name.encode()) % self.tasks != share:
                continue
            if info.type == fs.FileType.File and not parts and fnmatchcase(info.base_name, self.pattern) and info.base_name[0] not in "._":
                yield info
            elif info.type == fs.FileType.Directory and parts and fnmatchcase(info.base_name, parts[0]):
                yield from self._walk(system, info.path, parts[1:], None)
            elif info.type == fs.FileType.Directory and not parts and self.recursive:
                yield from self._walk(system, info.path, [], None)

    def read(self, partition: Share) -> Iterator[tuple]:
        system, inside, before = file_system(self.path)
        parts = inside.rstrip("/").split("/")
        fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?")), len(parts))
        kinds = {k.__name__: f for k, f in self.KINDS.items()}
        for info in self._walk(system, "/".join(parts[:fixed]) or "/", parts[fixed:], partition.number):
            row = {"path": before + info.path, "modified_ms": info.mtime_ns // 1_000_000, "size": info.size}
            if all(kinds[kind](row[name], value) for kind, name, value in self.filters):
                yield (*row.values(), self._head(system, info.path) if self.peek else None)

    def _head(self, system, path: str) -> str | None:
        """The first lines, and no more of the file; null where they aren't UTF-8."""
        data = b""
        with system.open_input_stream(path) as f:
            while data.count(b"\n") < self.peek and (more := f.read(CHUNK // 16)):
                data += more
        try:
            return b"\n".join(data.split(b"\n")[: self.peek]).decode()
        except UnicodeDecodeError:
            return None


@dataclass
class Span(InputPartition):
    number: int
    after: int
    until: int


class StreamReader(DataSourceStreamReader):
    """Files by their times: a batch holds those changed after its start and not after its end, new and rewritten ones alike. A file that
    changes again before it is listed moves to a later batch. The end lags behind the clock, so that no file of a batch's time is still to come."""

    def __init__(self, options: dict):
        self.files, self.lag = Reader(options), int(options.get("lag_ms", LAG_MS))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        return {"until": int(time.time() * 1000) - self.lag}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(i, start["until"], end["until"]) for i in range(self.files.tasks)]

    def read(self, partition: Span) -> Iterator[tuple]:
        self.files.filters = [("GreaterThan", "modified_ms", partition.after), ("LessThanOrEqual", "modified_ms", partition.until)]
        return self.files.read(Share(partition.number))


class SessionFiles(DataSource):
    """Options: path (may hold * and ? in folder names), pattern of file names, recursive, peek (first lines to read), tasks, lag_ms (streams)."""

    @classmethod
    def name(cls) -> str:
        return "session_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


def list_sessions(spark, path: str, pattern: str, recursive: bool = False, peek: int = 0) -> DataFrame:
    """(path, modified_ms, size, head) of files; nothing of them is read but what peek asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionFiles)
    return spark.read.format("session_files").option("path", path).option("pattern", pattern).option("recursive", str(recursive)).option("peek", peek).load()


def lines_of(system, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range of bytes; the last one whole, wherever it ends."""
    with system.open_input_file(path) as f:
        at, rest = max(0, start - 1), b""
        f.seek(at)
        skip = start > 0  # up to the end of a line that began before
        while at < end or rest and not skip:
            data = f.read(CHUNK)
            if not data:
                break
            parts = (rest + data).split(b"\n")
            rest = parts.pop()
            for line in parts:
                if skip:
                    skip = False
                elif at < end:
                    yield at, line
                else:
                    return
                at += len(line) + 1
            if skip:
                at, rest = at + len(rest), b""
        if rest and not skip and at < end:
            yield at, rest


def read_lines(listing: DataFrame, range_bytes: int = RANGE, marked: bool = False) -> DataFrame:
    """The listing's columns with (line_no, line) of each file's lines; a line's number is where it begins. Files that aren't UTF-8 throughout
    are left out whole (marked: their lines that aren't are null, and nothing is shuffled by file), files that have gone meanwhile have no lines."""
    keep = [c for c in listing.columns if c not in ("head", "size")]
    ranges = listing.select(*keep, F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes))).alias("_start"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join(f"`{c}` {t}" for c, t in listing.select(*keep).dtypes) + ", line_no bigint, line string"
    schema, at = to_arrow_schema(StructType.fromDDL(ddl)), keep.index("path")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                *kept, start = row.values()
                system, inside, _ = file_system(kept[at])
                held: list[tuple] = []
                size = 0
                try:
                    for place, line in lines_of(system, inside, start, start + range_bytes):
                        try:
                            held.append((place, line.decode()))
                        except UnicodeDecodeError:
                            held.append((place, None))
                        size += len(line)
                        if len(held) >= LINES or size >= 8 * CHUNK:
                            yield rows(kept, held)
                            held, size = [], 0
                except FileNotFoundError:
                    pass
                if held:
                    yield rows(kept, held)

    def rows(kept: list, held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([v] * len(held), f.type) for v, f in zip(kept, schema, strict=False)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([p for p, _ in held], pa.int64()), pa.array([x for _, x in held], pa.string())], schema=schema)

    spread = ranges.repartition(F.xxhash64("path", "_start")).select(*keep, "_start")
    found = spread.mapInArrow(run, ddl)
    if marked:
        return found
    bad = F.max(F.col("line").isNull()).over(Window.partitionBy("path"))
    return found.withColumn("_bad", bad).where(~F.col("_bad")).drop("_bad")
