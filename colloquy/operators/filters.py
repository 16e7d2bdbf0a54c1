"""Filters, argument resolution and listings over sessions and messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.text import DAY_MS, contains_line, sanitize

# Ids and labels of the sources.
SOURCES = [("claude-code", "CC"), ("opencode", "OC"), ("codex", "CDX"), ("gemini-cli", "GEM"), ("kiro-cli", "KIRO"), ("copilot-cli", "CPL"), ("cursor", "CUR")]
SOURCE_IDS = [s for s, _ in SOURCES]
RANGE_DAYS = {"today": 1, "week": 7, "month": 30, "all": None}


def source_table(spark: SparkSession) -> DataFrame:
    """(source, label) of the seven sources."""
    return spark.createDataFrame(SOURCES, "source string, label string")


def resolve_source(text: str | None) -> list[str] | None:
    """Id of a source named by id or label, whatever its case; None, that is no filter, for any other name."""
    found = [s for s, label in SOURCES if text and text.lower() in (s.lower(), label.lower())]
    return found or None


def resolve_range(text: str | None) -> str:
    return {"today": "today", "7d": "week", "week": "week", "30d": "month", "month": "month"}.get((text or "").lower(), "all")


def enabled_sources(enabled: Iterable[str] | None = None, disabled: Iterable[str] = ()) -> list[str]:
    """Known sources that are switched on. Unknown ids count for nothing, sources that nobody mentions are on, and switching all off switches none off."""
    off = set(disabled) & set(SOURCE_IDS)
    if enabled is not None:
        off |= set(SOURCE_IDS) - set(enabled)
    return [s for s in SOURCE_IDS if s not in off] or list(SOURCE_IDS)


def default_scope(enabled: list[str]) -> list[str] | None:
    """No filter when all sources are on."""
    return None if set(enabled) >= set(SOURCE_IDS) else enabled


def time_cutoff(time_range: str, as_of_ms: int) -> int | None:
    days = RANGE_DAYS[time_range]
    return None if days is None else as_of_ms - days * DAY_MS


def session_filter(sources: list[str] | None = None, time_range: str = "all", directory: str | None = None, as_of_ms: int = 0) -> Column:
    """Condition on sessions; every part reaches the scan. The directory is a LIKE prefix, % and _ in it stay wildcards."""
    out = F.lit(True)
    if sources:
        out = out & F.col("source").isin(list(sources))
    cutoff = time_cutoff(time_range, as_of_ms)
    if cutoff is not None:
        out = out & (F.col("started_at") >= cutoff)
    if directory:
        out = out & F.col("directory").ilike(directory + "%")
    return out


def within_window(cutoff_ms: int | None) -> Column:
    """Sync window: last touched at the cutoff or later."""
    touched = F.coalesce("updated_at", "started_at")
    return F.lit(True) if cutoff_ms is None else touched >= cutoff_ms


def outside_window_count(sessions: DataFrame, cutoff_ms: int) -> DataFrame:
    return sessions.agg(F.count_if(~within_window(cutoff_ms)).alias("filtered"))


def known_role(c: str = "role") -> Column:
    return F.col(c).isin("user", "assistant")


def embeddable(role: str = "role", content: str = "content") -> Column:
    return (F.col(role) == "user") & (F.length(content) > 2)


def sessions_by_id(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    return sessions.join(ids.select("session_id").distinct(), sessions["id"] == F.col("session_id"), "left_semi")


def session_meta(sessions: DataFrame, source: str | None = None) -> DataFrame:
    """(source, source_id, updated_at, message_count), of one source if named."""
    out = sessions.select("source", "source_id", "updated_at", "message_count")
    return out.where(F.col("source") == source) if source else out


def messages_of(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.where(F.col("session_id") == session_id).orderBy("seq")


def recent_sessions(sessions: DataFrame, limit: int, sources: list[str] | None = None, time_range: str = "all", as_of_ms: int = 0) -> DataFrame:
    """Newest sessions within the filters."""
    return sessions.where(session_filter(sources, time_range, None, as_of_ms)).orderBy(F.col("started_at").desc(), "id").limit(limit)


def recent_then_filter(sessions: DataFrame, sources: list[str] | None, time_range: str, as_of_ms: int, first: int = 200) -> DataFrame:
    """The newest sessions of all, and of these the ones within the filters: fewer rows may remain."""
    return sessions.orderBy(F.col("started_at").desc(), "id").limit(first).where(session_filter(sources, time_range, None, as_of_ms))


def by_newest(results: DataFrame) -> DataFrame:
    """Search results (a list that is already limited) by newest instead of relevance, with their new place; equal times keep their order."""
    return results.withColumn("place", F.row_number().over(Window.orderBy(F.col("started_at").desc(), "position"))).orderBy("place")


def preview(messages: DataFrame, count: int = 30, chars: int = 300, lines: int = 6) -> DataFrame:
    """The first messages of each session, cut to some characters and lines, each line sanitised."""
    order = Window.partitionBy("session_id").orderBy("seq")
    first = messages.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count)
    text = F.array_join(F.transform(F.slice(F.split(F.substring("content", 1, chars), "\n"), 1, lines), sanitize), "\n")
    return first.select("session_id", "seq", "role", text.alias("preview"))


def in_session_search(messages: DataFrame, needle: str) -> DataFrame:
    """Messages with a line that holds the needle; a blank needle finds nothing."""
    found = contains_line("content", needle) if needle else F.lit(False)
    return messages.where(found).select("session_id", "seq", "role")


def resume_command(source: Column, source_id: Column) -> Column:
    """How a session is taken up again in its own tool; null where the tool has no such command."""
    # Commands of the tools.
    return F.when(source == "claude-code", F.concat(F.lit("claude --resume "), source_id)).when(source == "opencode", F.concat(F.lit("opencode --session "), source_id)).when(source == "codex", F.concat(F.lit("codex resume "), source_id)).when(source == "copilot-cli", F.concat(F.lit("copilot --resume="), source_id))
