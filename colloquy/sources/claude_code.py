"""Project transcripts as JSON lines, with a sidecar index of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import variant as V
from colloquy.functions.text import decode_directory, rfc3339_ms
from colloquy.sources.files import Folder, joined, json_lines, list_files, named, parent_of, read_all, scan_files, stem_of
from colloquy.sources.rows import events, gather, side

SOURCE = "claude-code"


def folders(root: str) -> list[Folder]:
    return [Folder(f"{root}/projects/*", "*.jsonl"), Folder(f"{root}/transcripts", "*.jsonl", recursive=True)]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_ms, source_id, directory): one level under projects, whose folder names the directory; any level under transcripts, without one."""
    projects, loose = (list_files(spark, [f]) for f in folders(root))
    both = projects.withColumn("directory", decode_directory(parent_of())).unionByName(loose.withColumn("directory", F.lit(None).cast("string")))
    return both.withColumn("source_id", stem_of())


def sidecars(files: DataFrame) -> DataFrame:
    """(source_id, cwd, started, entrypoint) from files (path, content) of session records; a record without start time starts at 0."""
    v = files.select(V.parse("content").alias("v")).where(F.col("v").isNotNull())
    rows = v.select(V.string(F.col("v"), "$.sessionId").alias("source_id"), V.string(F.col("v"), "$.cwd").alias("cwd"), F.coalesce(V.integer(F.col("v"), "$.startedAt"), F.lit(0)).alias("started"), V.string(F.col("v"), "$.entrypoint").alias("entrypoint"))
    return rows.where(F.col("source_id").isNotNull()).dropDuplicates(["source_id"])


def content_text(content: Column) -> Column:
    """Text of a message's content: a string as it is; texts, tool uses and tool results of an array, a line each."""

    def inner(x: Column) -> Column:
        texts = F.transform(V.array(x), lambda b: F.when(V.string(b, "$.type") == "text", V.string(b, "$.text")))
        return F.when(V.is_kind(x, "STRING"), F.array(V.string(x))).when(V.is_kind(x, "ARRAY"), texts)

    def item(x: Column) -> Column:
        kind = V.string(x, "$.type")
        use = F.when(V.present(x, "$.input"), named(x, "$.name", argument_text_of(x)))
        none = F.array().cast("array<string>")
        return F.when(kind == "text", F.array(V.string(x, "$.text"))).when(kind == "tool_use", F.array(use)).when(kind == "tool_result", F.coalesce(inner(V.get(x, "$.content")), none)).otherwise(none)

    return F.when(V.is_kind(content, "STRING"), V.string(content)).when(V.is_kind(content, "ARRAY"), joined(F.flatten(F.transform(V.array(content), item)))).otherwise(F.lit(""))


def argument_text_of(x: Column) -> Column:
    return V.text_of(V.get(x, "$.input"))


def event_rows(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Event rows of files (path, modified_ms, content or lines, source_id, directory), and of the sidecar index."""
    v = F.col("v")
    kind, content = V.string(v, "$.type"), content_text(V.get(v, "$.message.content"))
    said = kind.isin("user", "assistant") & V.present(v, "$.message") & (F.col("content") != "")
    found = events(
        json_lines(files).withColumn("content", content), source=F.lit(SOURCE), entry=F.col("path"), place=F.col("line_no"), role=F.when(said, kind), content=F.col("content"), timestamp=rfc3339_ms(V.string(v, "$.timestamp")),
        source_id=F.col("source_id"), directory=F.col("directory"), updated_at=F.col("modified_ms"), listing=F.xxhash64("path"), bad=F.col("bad"),
    )
    return found if index is None else found.unionByName(side(index.select("source_id", F.col("cwd").alias("directory"), F.col("started").alias("started_at"), "entrypoint"), SOURCE))


def parse(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Raw sessions of files (path, modified_ms, content, source_id, directory)."""
    return gather(event_rows(files, index))


def scan_events(spark: SparkSession, root: str, stored: DataFrame | None = None, cutoff_ms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(event rows, counts of what was pruned) of the files that stored sessions and the cutoff leave."""
    files, counts = scan_files(spark, folders(root), listing(spark, root), stored, cutoff_ms)
    return event_rows(files, sidecars(read_all(spark, [Folder(f"{root}/sessions", "*.json")]))), counts


def scan_changed(spark: SparkSession, root: str, stored: DataFrame | None = None, cutoff_ms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(raw sessions, counts of what was pruned) of the files that stored sessions and the cutoff leave."""
    found, counts = scan_events(spark, root, stored, cutoff_ms)
    return gather(found), counts


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All sessions under a root."""
    return scan_changed(spark, root)[0]
