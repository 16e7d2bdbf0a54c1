"""Rollout logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import variant as V
from colloquy.functions.text import rfc3339_ms
from colloquy.sources.files import Folder, body, joined, json_lines, list_files, named, scan_files, stem_of
from colloquy.sources.rows import events, gather, told

SOURCE = "codex"
UUID = r"-([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"


def file_id(path: str | Column = "path") -> Column:
    """The id that ends a rollout's name; null for any other name."""
    found = F.regexp_extract(stem_of(path), UUID, 1)
    return F.when(found != "", found)


def folders(root: str) -> list[Folder]:
    return [Folder(f"{root}/{folder}", pattern, recursive=True) for folder in ("sessions", "archived_sessions") for pattern in ("*.jsonl", "*.json")]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_ms, source_id) of rollouts in use and archived, at any level."""
    return list_files(spark, folders(root)).withColumn("source_id", file_id()).where(F.col("source_id").isNotNull())


def content_text(content: Column) -> Column:
    def item(x: Column) -> Column:
        kind = V.string(x, "$.type")
        return F.when(kind.isin("text", "output_text"), V.string(x, "$.text")).when(kind == "function_call", named(x, "$.name", V.string(x, "$.arguments"))).when(kind == "function_call_output", V.string(x, "$.output"))

    return F.when(V.is_kind(content, "ARRAY"), joined(F.transform(V.array(content), item))).otherwise(F.lit(""))


def event_rows(files: DataFrame) -> DataFrame:
    """Event rows of files (path, modified_ms, content or lines). A session is known by the id in its file's name, and its time of update is the file's.

    A file named otherwise goes by the id in its last session record, else by its name. That record counts even where it lacks a
    field; an answer logged in two forms is two messages."""
    lines = json_lines(files.select("path", "modified_ms", *body(files)))
    v = F.col("v")
    kind, payload = V.string(v, "$.type"), V.string(v, "$.payload.type")
    record = (kind == "session_meta") & V.present(v, "$.payload")
    event = (kind == "event_msg") & payload.isin("user_message", "agent_message")
    answer = (kind == "response_item") & (payload == "message") & (V.string(v, "$.payload.role") == "assistant")
    content = F.when(event, V.string(v, "$.payload.message")).when(answer, content_text(V.get(v, "$.payload.content")))
    said = F.when(F.col("content") != "", F.when(payload == "user_message", "user").otherwise("assistant"))
    about = told(V.string(v, "$.payload.id"), V.string(v, "$.payload.cwd"), rfc3339_ms(V.string(v, "$.payload.timestamp")))
    return events(
        lines.withColumn("content", content), source=F.lit(SOURCE), entry=F.col("path"), place=F.col("line_no"), role=said, content=F.col("content"), timestamp=rfc3339_ms(V.string(v, "$.timestamp")), told=F.when(record, about),
        source_id=file_id(), fallback=stem_of(), updated_at=F.col("modified_ms"), listing=F.xxhash64("path"), bad=F.col("bad"),
    )


def parse(files: DataFrame) -> DataFrame:
    """Raw sessions of files (path, modified_ms, content)."""
    return gather(event_rows(files))


def scan_events(spark: SparkSession, root: str, stored: DataFrame | None = None, cutoff_ms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(event rows, counts of what was pruned) of the files that stored sessions and the cutoff leave."""
    files, counts = scan_files(spark, folders(root), listing(spark, root), stored, cutoff_ms)
    return event_rows(files), counts


def scan_changed(spark: SparkSession, root: str, stored: DataFrame | None = None, cutoff_ms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(raw sessions, counts of what was pruned) of the files that stored sessions and the cutoff leave."""
    found, counts = scan_events(spark, root, stored, cutoff_ms)
    return gather(found), counts


def scan(spark: SparkSession, root: str) -> DataFrame:
    return scan_changed(spark, root)[0]
