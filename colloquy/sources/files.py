"""Listing and reading of session files.

A listing reads paths, times and sizes only, in tasks. What it prunes is never opened: files that survive are read by lines, each in as
many tasks as it has ranges of bytes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import variant as V
from colloquy.functions.text import trim
from colloquy.sources.session_files import list_sessions, read_lines

RAW_MESSAGE = "struct<role:string,content:string,timestamp:bigint>"
LISTED = "path string, modified_ms bigint"
SIZED = f"{LISTED}, size bigint"


@dataclass(frozen=True)
class Folder:
    """Files of a name under a path, which may be a glob."""

    path: str
    pattern: str
    recursive: bool = False


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that a glob stands for, exists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _reader(spark: SparkSession):
    return spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")


def _load(spark: SparkSession, folders: list[Folder], columns: list[Column], schema: str) -> DataFrame:
    """Columns of all files of the folders; a folder that is not there holds none."""
    parts = []
    for f in folders:
        if is_there(spark, f.path):
            reader = _reader(spark).option("pathGlobFilter", f.pattern)
            parts.append((reader.option("recursiveFileLookup", "true") if f.recursive else reader).load(f.path).select(*columns))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _times() -> list[Column]:
    return [F.col("path"), F.unix_millis("modificationTime").alias("modified_ms")]


def list_files(spark: SparkSession, folders: list[Folder], peek: int = 0) -> DataFrame:
    """(path, modified_ms, size) of files, and with peek their first lines as head; no other content is read."""
    columns = ["path", "modified_ms", "size"] + (["head"] if peek else [])
    return reduce(DataFrame.unionByName, [list_sessions(spark, f.path, f.pattern, f.recursive, peek).select(*columns) for f in folders])


def name_of(path: str | Column = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem_of(path: str | Column = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def parent_of(path: str | Column = "path") -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def prune(listing: DataFrame, stored: DataFrame, cutoff_ms: int | None = None) -> DataFrame:
    """A listing (path, modified_ms, source_id) with what a scan does to each: filtered (older than the cutoff), skipped (time as stored), or parse."""
    known = stored.select("source_id", F.col("updated_at").alias("stored_at"))
    old = F.lit(False) if cutoff_ms is None else F.col("modified_ms") < cutoff_ms
    todo = F.when(old, "filtered").when(F.col("modified_ms").eqNullSafe(F.col("stored_at")), "skipped").otherwise("parse")
    return listing.join(known, "source_id", "left").withColumn("scan", todo).drop("stored_at")


def _texts() -> list[Column]:
    return [*_times(), F.col("content").cast("string").alias("content")]


def read_all(spark: SparkSession, folders: list[Folder]) -> DataFrame:
    """(path, modified_ms, content) of all files that are valid UTF-8. A bad file is left out whole and the scan goes on."""
    return _load(spark, folders, _texts(), f"{LISTED}, content string").where(F.is_valid_utf8("content"))


def scan_files(spark: SparkSession, folders: list[Folder], listing: DataFrame, stored: DataFrame | None = None, cutoff_ms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(lines of files with the listing's columns, (action, sessions) of what was pruned): all files, or with stored sessions those that prune() leaves."""
    if stored is None:
        return read_lines(listing, marked=True), None
    marked = prune(listing, stored, cutoff_ms)
    return read_lines(marked.where("scan = 'parse'").drop("scan"), marked=True), pruned(marked)


def pruned(marked: DataFrame) -> DataFrame:
    """(action, sessions) of a listing's files that are not parsed."""
    return marked.where("scan <> 'parse'").groupBy(F.when(F.col("scan") == "skipped", "unchanged").otherwise(F.col("scan")).alias("action")).agg(F.count("*").alias("sessions"))


def body(files: DataFrame) -> list[str]:
    """The columns that hold what files say: whole contents, or numbered lines."""
    return ["line_no", "line"] if "line" in files.columns else ["content"]


def json_lines(files: DataFrame) -> DataFrame:
    """The files' lines that are JSON: all columns but the content, with line number and value; and as bad those that are no text."""
    keep = [c for c in files.columns if c not in body(files)]
    if "line" in files.columns:
        return files.select(*keep, "line_no", V.parse(trim("line")).alias("v"), F.col("line").isNull().alias("bad")).where(F.col("v").isNotNull() | F.col("bad"))
    lines = files.select(*keep, F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return lines.select(*keep, "line_no", V.parse(trim("line")).alias("v"), F.lit(False).alias("bad")).where(F.col("v").isNotNull())


def joined(parts: Column) -> Column:
    """Array of texts as one, null ones left out."""
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")


def named(item: Column, name: str, value: Column) -> Column:
    """[name] value, the name "tool" if there is none."""
    return F.concat(F.lit("["), F.coalesce(V.string(item, name), F.lit("tool")), F.lit("] "), value)


def argument_text(item: Column, path: str) -> Column:
    """Compact JSON of a value, empty where it is absent."""
    return F.coalesce(V.text_of(V.get(item, path)), F.lit(""))


def assemble(messages: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Messages (role, content, timestamp) in order as an array for each key; keys without messages have no row."""
    item = F.struct(*order, F.struct("role", "content", F.col("timestamp").cast("bigint").alias("timestamp")).alias("m"))
    return messages.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).cast(f"array<{RAW_MESSAGE}>").alias("messages"))
