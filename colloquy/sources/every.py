"""All seven sources in one scan, and the sync that starts from files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.filters import SOURCE_IDS
from colloquy.operators.store import Store
from colloquy.operators.sync import SESSION_SCHEMA, sync_rows
from colloquy.sources import claude_code, codex, copilot, cursor, gemini, kiro, opencode
from colloquy.sources.rows import EVENT_SCHEMA, gather, rows_of

PRUNED = "action string, sessions bigint"


def scan_events(spark: SparkSession, roots: dict, stored: DataFrame | None = None, cutoff_ms: int | None = None, enabled: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(event rows of all sources, (action, sessions) of files pruned before they were opened).

    roots: by source id the folder of a source of files; for cursor a folder, or (folder, key-value table or None); for opencode its
    tables (session, message, part); for kiro-cli its table. A source that is not named, or whose folder is not there, has no
    sessions. With stored sessions, only what changed is opened."""
    on = [s for s in (enabled or SOURCE_IDS) if s in roots]
    events, counts = [spark.createDataFrame([], EVENT_SCHEMA)], [spark.createDataFrame([], PRUNED)]
    known = lambda source: stored.where(F.col("source") == source) if stored is not None else None
    for source in on:
        root, pruned = roots[source], None
        if source == "opencode":
            found = opencode.event_rows(*root, cutoff_ms=cutoff_ms, stored=known(source))
        elif source == "kiro-cli":
            found = rows_of(kiro.parse(root))
        elif source == "gemini-cli":
            found = rows_of(gemini.scan(spark, root))
        elif source == "cursor":
            folder, items = root if isinstance(root, tuple) else (root, None)
            found, pruned = cursor.scan_events(spark, folder, known(source), cutoff_ms, items)
        else:
            found, pruned = {"claude-code": claude_code, "codex": codex, "copilot-cli": copilot}[source].scan_events(spark, root, known(source), cutoff_ms)
        events.append(found)
        if pruned is not None:
            counts.append(pruned)
    return reduce(DataFrame.unionByName, events), reduce(DataFrame.unionByName, counts)


def scan_all(spark: SparkSession, roots: dict, stored: DataFrame | None = None, cutoff_ms: int | None = None, enabled: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw sessions of all sources, each with an array of its messages; counts of what was pruned), as scan_events."""
    found, counts = scan_events(spark, roots, stored, cutoff_ms, enabled)
    return gather(found), counts


def sync_sources(spark: SparkSession, roots: dict, store: Store, cutoff_ms: int | None = None, force: bool = False, enabled: list[str] | None = None) -> DataFrame:
    """One run from files to tables: scan, prune, plan, merge, write; gives the counters. A forced run opens and replaces everything."""
    nothing = force or not store.manifest()["number"]  # then every file is opened, without a list of them
    found, pruned = scan_events(spark, roots, None if nothing else store.read("sessions", SESSION_SCHEMA), cutoff_ms, enabled)
    return sync_rows(found, store, cutoff_ms, force, pruned=pruned)
