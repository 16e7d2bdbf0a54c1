"""Queries over a store that several runs have filled from the given conversations.

The first run brings two thirds of the sessions, some with other words; the second the rest and those again as they are; the third some
that only their time has changed. What the store then holds must equal the given tables, and what its index finds the plain search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators import embed, index, signatures, stats, summaries, sync
from colloquy.operators.scratch import scratch
from colloquy.operators.store import Store
from colloquy.plans.views import SQL, Views
from colloquy.sources import rows
from colloquy.streaming import jobs

#: The views with the ids that a store gives.
STORED_SQL = SQL.replace("messages AS (", "messages0 AS (").replace("sessions AS (", "sessions0 AS (") + """,
ids AS (SELECT id AS old, sha256(source || chr(10) || source_id) AS id FROM sessions0),
sessions AS (SELECT ids.id, s.* EXCLUDE (id) FROM sessions0 s JOIN ids ON old = s.id),
messages AS (SELECT ids.id AS session_id, m.* EXCLUDE (session_id) FROM messages0 m JOIN ids ON old = m.session_id)"""


def filled(v: Views) -> Store:
    c = F.regexp_extract("id", r"\d+", 0).cast("bigint")
    item = F.struct("seq", F.struct("role", "content", "timestamp").alias("m"))
    said = v.messages.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("messages"))
    raw = v.sessions.join(said.hint("merge"), F.col("id") == F.col("session_id")).select("source", "source_id", "directory", "started_at", F.lit(1).cast("bigint").alias("updated_at"), "entrypoint", c.alias("listing"), "messages")
    n, store = F.col("listing"), Store(v.spark, scratch(v.spark))
    other = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit("the zzz "), m["content"]).alias("content"), m["timestamp"].alias("timestamp")))
    sync.sync(raw.where(n % 3 != 0).withColumn("messages", F.when(n % 5 == 0, other).otherwise(F.col("messages"))), store)
    sync.sync(raw.where((n % 3 == 0) | (n % 5 == 0)).withColumn("updated_at", F.lit(2).cast("bigint")), store)
    sync.upkeep(store)
    sync.sync(raw.where(n % 7 == 0).withColumn("updated_at", F.lit(3).cast("bigint")), store)
    return store


def filled_by_rows(v: Views) -> Store:
    """As filled(), from rows of messages that are never gathered; the numbers that messages have are stretched, so that a session has many stretches."""
    n, store = F.regexp_extract("id", r"\d+", 0).cast("bigint"), Store(v.spark, scratch(v.spark))
    said = v.messages.select("session_id", "role", F.col("content").alias("text"), "timestamp", (F.col("seq").cast("bigint") * (rows.STRETCH // 2)).alias("place")).join(v.sessions.withColumn("n", n).hint("merge"), F.col("session_id") == F.col("id"))
    found = said.select("source", F.col("id").alias("entry"), "place", "role", "text", "timestamp", "source_id", "directory", "started_at", "entrypoint", "n")

    def run(which: Column, at: int, content: Column) -> None:
        same = {"source": F.col("source"), "entry": F.col("entry"), "place": F.col("place"), "source_id": F.col("source_id"), "directory": F.col("directory"), "started_at": F.col("started_at"), "dated": F.lit(True), "listing": F.col("n")}
        sync.sync_rows(rows.events(found.where(which), **same, role=F.col("role"), content=content, timestamp=F.col("timestamp"), updated_at=F.lit(at), told=F.when(F.col("place") == 0, rows.told(entrypoint=F.col("entrypoint")))), store)

    n, text = F.col("n"), F.col("text")
    run(n % 3 != 0, 1, F.when(n % 5 == 0, F.concat(F.lit("the zzz "), text)).otherwise(text))
    run((n % 3 == 0) | (n % 5 == 0), 2, text)
    sync.upkeep(store)
    run(n % 7 == 0, 3, text)
    return store


def _tables(store: Store) -> tuple[DataFrame, DataFrame]:
    manifest = store.manifest()
    return store.read("sessions", sync.SESSION_SCHEMA, manifest), store.read("messages", sync.MESSAGE_SCHEMA, manifest)


def sync_stored(v: Views, fill: Callable[[Views], Store] = filled) -> DataFrame:
    """Every session as the store has it after all runs, and what its messages say."""
    sessions, messages = _tables(fill(v))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat("role", "content").alias("t")))), lambda x: x["t"]), "\n")
    said = messages.groupBy(F.col("session_id").alias("id")).agg(F.md5(text.cast("binary")).alias("digest"))
    return sessions.join(said.hint("merge"), "id").select("id", "source_id", "title", "directory", "message_count", "updated_at", "digest")


def fts_indexed(v: Views, words: str) -> DataFrame:
    """Keyword search in the index that the runs kept up."""
    store = filled(v)
    sessions, messages = _tables(store)
    found = index.search_index(store, sessions, messages, words)
    # the list is the small side, whatever its plan makes Spark expect: else the driver builds a table of all sessions
    return F.broadcast(found).join(sessions.select(F.col("id").alias("session_id"), "source_id"), "session_id").select("source_id", "rank")


def index_blocks(v: Views, words: str) -> DataFrame:
    """(term, blocks, blocks_read) of a search in that index."""
    store = filled(v)
    return index.blocks_read(store, _tables(store)[0], words, 20)


def _unsteady(texts: list[str]) -> np.ndarray:
    """The default encoder, failing for texts whose length is a multiple of 17."""
    if any(len(t) % 17 == 0 for t in texts):
        raise ValueError("no luck")
    return embed.HashedTerms(16)(texts)


def embedding_runs(v: Views) -> DataFrame:
    """Embedding state after a run in which some texts fail and a second one that leaves failed sessions alone."""
    store = filled(v)
    jobs.embed_run(store, _unsteady, at_ms=1)
    jobs.embed_run(store, embed.HashedTerms(16), at_ms=2)
    sessions, messages = _tables(store)
    state = stats.embedding_state(sessions, messages, store.read("vectors", sync.VECTOR_SCHEMA), store.read("failures", sync.FAILURE_SCHEMA))
    return state.join(sessions.select(F.col("id").alias("session_id"), "source_id").hint("merge"), "session_id").select("source_id", "units_total", "units_done", "status", "last_error")


def _number() -> Column:
    """The number in a session's id of its source."""
    return F.regexp_extract("source_id", r"\d+", 0).cast("bigint")


def _come_again(store: Store, sessions: DataFrame, messages: DataFrame, which: Column) -> None:
    """Some sessions with the messages they had and another time."""
    item = F.struct("seq", F.struct("role", "content", "timestamp").alias("m"))
    said = messages.groupBy(F.col("session_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("messages"))
    again = sessions.where(which).join(said.hint("merge"), "id")
    sync.sync(again.select("source", "source_id", "directory", "started_at", F.lit(9).cast("bigint").alias("updated_at"), "entrypoint", _number().alias("listing"), "messages"), store)


def _counted(v: Views) -> Store:
    """A store in which some texts have failed, then every 17th session is deleted, then some sessions come again with another time."""
    store = filled(v)
    jobs.embed_run(store, _unsteady, at_ms=1)
    sessions, messages = _tables(store)
    sync.delete_stored(store, sessions.where(_number() % 17 == 0).select(F.col("id").alias("session_id")))
    _come_again(store, sessions, messages, (_number() % 19 == 0) & (_number() % 17 != 0))
    return store


def summaries_kept(v: Views) -> DataFrame:
    """The sources' summary and embedding progress that the runs have kept up."""
    return summaries.source_summary(_counted(v))


def scope_kept(v: Views, sources: list[str], cutoff_ms: int) -> DataFrame:
    """Totals and progress of a scope that the runs have kept up."""
    return summaries.scope_metrics(_counted(v), sources, cutoff_ms, now_ms=2)


def in_session_signed(v: Views, needle: str) -> DataFrame:
    """Substring search that reads the chunks whose signatures can hold the needle; what the last run has added is not signed yet."""
    store = filled(v)
    signatures.sign(store, chunk_bytes=1 << 16)
    sessions, messages = _tables(store)
    _come_again(store, sessions, messages, _number() % 11 == 0)
    return signatures.search_lines(store, needle)


SYNC_STORED = STORED_SQL + """ SELECT id, source_id, title, directory, message_count, CASE WHEN c % 7 = 0 THEN 3 WHEN c % 3 = 0 OR c % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS updated_at, digest
FROM (SELECT *, regexp_extract(source_id, '\\d+')::BIGINT AS c FROM sessions) JOIN (SELECT session_id AS id, md5(string_agg(role || content, chr(10) ORDER BY seq)) AS digest FROM messages GROUP BY 1) USING (id)"""

EMBEDDING_RUNS = STORED_SQL + """, units AS (SELECT id, source_id, m.session_id IS NOT NULL AS is_unit, coalesce((9 + length(substr(title || ': ' || content, 1, 500))) % 17 = 0, false) AS fails
  FROM sessions LEFT JOIN (SELECT * FROM messages WHERE role = 'user' AND length(content) > 2) m ON m.session_id = id)
SELECT source_id, count(*) FILTER (is_unit) AS units_total, count(*) FILTER (is_unit AND NOT fails) AS units_done, CASE WHEN bool_or(fails) THEN 'failed' ELSE 'done' END AS status, CASE WHEN bool_or(fails) THEN 'no luck' END AS last_error FROM units GROUP BY ALL"""

COUNTED = STORED_SQL + """, units AS (SELECT session_id, bool_or(coalesce(role = 'user' AND length(content) > 2, false)) AS has, bool_or(coalesce(role = 'user' AND length(content) > 2 AND (9 + length(substr(title || ': ' || content, 1, 500))) % 17 = 0, false)) AS fails
  FROM messages JOIN sessions ON id = session_id GROUP BY 1),
counted AS (SELECT *, CASE WHEN NOT has THEN 'done' WHEN c % 19 = 0 THEN 'pending' WHEN fails THEN 'failed' ELSE 'done' END AS status
  FROM (SELECT *, regexp_extract(source_id, '\\d+')::BIGINT AS c FROM sessions) JOIN units ON id = session_id WHERE c % 17 <> 0)"""

_PROGRESS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("done", "failed", "pending"))
SUMMARIES_KEPT = COUNTED + f" SELECT coalesce(source, 'total') AS source, count(*) AS sessions, sum(message_count)::BIGINT AS messages, min(started_at) AS oldest, max(started_at) AS newest, {_PROGRESS} FROM counted GROUP BY ROLLUP (source)"
SCOPE_KEPT = COUNTED + f" SELECT count(*) AS sessions, coalesce(sum(message_count), 0)::BIGINT AS messages, count(*) AS total, {_PROGRESS}, 0::BIGINT AS processing, NULL::VARCHAR AS processing_title FROM counted WHERE "
