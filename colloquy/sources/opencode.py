"""A relational store: tables session, message and part, taken as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import variant as V
from colloquy.functions.text import trim
from colloquy.operators.sync import tabular_changes
from colloquy.sources.files import named
from colloquy.sources.rows import events, gather

SOURCE = "opencode"


def part_text(part: Column) -> Column:
    """Text of a part: untrimmed, null where blank; tool parts by their input, else their result."""
    kind, text = V.string(part, "$.type"), V.string(part, "$.text")
    data = F.coalesce(V.get(part, "$.input"), V.get(part, "$.result"))
    return F.when((kind == "text") & (trim(text) != ""), text).when(kind.isin("tool-invocation", "tool-result"), named(part, "$.toolName", V.text_of(data)))


def counted(part: Column) -> Column:
    """Whether a part makes a message."""
    kind = V.string(part, "$.type")
    return ((kind == "text") & (trim(V.string(part, "$.text")) != "")) | ((kind == "tool-invocation") & V.present(part, "$.input")) | ((kind == "tool-result") & V.present(part, "$.result"))


def message_parts(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(session_id, created, part_id, role, content) of parts that make messages."""
    m = messages.select(F.col("id").alias("message_id"), "session_id", F.col("time_created").alias("created"), V.string(V.parse("data"), "$.role").alias("role")).where(F.col("role").isin("user", "assistant"))
    p = parts.select(F.col("id").alias("part_id"), "message_id", V.parse("data").alias("part")).where(F.col("part").isNotNull() & F.coalesce(counted(F.col("part")), F.lit(False)))
    return m.join(p, "message_id").select("session_id", "created", "part_id", "role", part_text(F.col("part")).alias("content"))


def message_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("session_id").agg(F.count("*").cast("int").alias("message_count"))


def sessions_in_window(sessions: DataFrame, cutoff_ms: int | None = None) -> DataFrame:
    """Sessions touched at the cutoff or later; rows that lack an id, directory or creation time are left out."""
    kept = sessions.dropna(subset=["id", "directory", "time_created"])
    return kept if cutoff_ms is None else kept.where(F.coalesce("time_updated", "time_created") >= cutoff_ms)


def event_rows(sessions: DataFrame, messages: DataFrame, parts: DataFrame, cutoff_ms: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Event rows; with stored sessions, only of those whose time or message count differs, told before any part is rendered."""
    scope = sessions_in_window(sessions, cutoff_ms).select(F.col("id").alias("session_id"), "directory", "time_created", "time_updated")
    found = message_parts(messages, parts)
    if stored is not None:
        listed = scope.join(message_counts(found), "session_id").select(F.col("session_id").alias("source_id"), F.col("time_updated").alias("updated_at"), "message_count")
        changed = tabular_changes(listed, stored).select(F.col("source_id").alias("session_id"))
        found = found.join(changed, "session_id", "left_semi")
    return events(
        found.join(scope, "session_id"), source=F.lit(SOURCE), entry=F.col("session_id"), place=F.col("created"), tie=F.col("part_id"), role=F.col("role"), content=F.col("content"), timestamp=F.col("created"),
        source_id=F.col("session_id"), directory=F.col("directory"), started_at=F.col("time_created"), dated=F.lit(True), updated_at=F.col("time_updated"), listing=F.xxhash64("session_id"),
    )


def parse(sessions: DataFrame, messages: DataFrame, parts: DataFrame, cutoff_ms: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Raw sessions, as event_rows."""
    return gather(event_rows(sessions, messages, parts, cutoff_ms, stored))
