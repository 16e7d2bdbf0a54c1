"""Summaries kept up by the sync: what a run changes is added to counts, what it replaces, deletes or embeds is taken back from them.

Two tables of signed counts: ``days`` by source and day, and ``starts`` by source and time of start, sorted by both. A scope's whole days
are sums of ``days``; the day that its cutoff cuts, and the days that hold a source's oldest and newest session, are looked up in
``starts``, where a filter on source and time reaches the files. No session or message is read for a summary, but for those in
somebody's hands: claims end by the clock, so their sessions are looked up when asked for.

Sessions without a time of start count under no day: they are in scopes without a cutoff only. A scope by folder isn't kept; for it there
are ``stats.scope_totals`` and ``stats.embedding_progress``. Stores that were filled before there were summaries get them by ``recount``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import DAY_MS, date_range, percentage
from colloquy.operators.index import like_size
from colloquy.operators.stats import embedding_state, newest_processing_title
from colloquy.operators.store import ALL, Store

COUNTS = ["sessions", "messages", "done", "failed", "pending"]
_COUNTS = ", ".join(f"{c} bigint" for c in COUNTS)
#: Tables of signed counts, and the columns that their rows are sums by.
TABLES = {"days": (f"source string, day bigint, {_COUNTS}", ["source", "day"]), "starts": (f"source string, started_at bigint, {_COUNTS}", ["source", "started_at"])}

SESSIONS = "id string, source string, title string, started_at bigint, updated_at bigint, message_count int"
MESSAGES = "message_id bigint, session_id string, role string, content string"
VECTORS = "message_id bigint, session_id string"
FAILURES = "session_id string, error string, at bigint"
CLAIMS = "session_id string, run string, until bigint"


def _settled(status: str | Column) -> Column:
    """What is kept of a status: half done counts as pending, as it is when nobody has it in hands."""
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status.isin("done", "failed"), status).otherwise("pending")


def marked(sessions: DataFrame, messages: DataFrame, vectors: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(id, source, started_at, messages, status) of sessions: what each of them counts as."""
    state = embedding_state(sessions, messages, vectors, failures).select(F.col("session_id").alias("id"), _settled("status").alias("status"))
    return sessions.join(state.hint("merge"), "id").select("id", "source", "started_at", F.col("message_count").cast("bigint").alias("messages"), "status")


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts added up; keys for which nothing is left go."""
    summed = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return summed.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in COUNTS]))


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    one = F.lit(sign).cast("bigint")
    return rows.select("source", "started_at", one.alias("sessions"), (one * F.col("messages")).alias("messages"), *[F.when(F.col("status") == s, one).otherwise(F.lit(0).cast("bigint")).alias(s) for s in COUNTS[2:]])


def kept(manifest: dict) -> bool:
    """Whether summaries follow the store: from its first rows on, or since recount()."""
    return "starts" in manifest["tables"] or not manifest["tables"].get("sessions")


def unkept(base: dict) -> tuple:
    """Tables that must not have appeared by the commit of a run that keeps no summaries: it would be missing in those."""
    return () if kept(base) else ("starts",)


def deltas_of(store: Store, base: dict, come: DataFrame | None, gone: DataFrame | None) -> list[tuple]:
    """What sessions that come and go (as ``marked`` gives them) change, as versions that no manifest names yet."""
    if not kept(base):
        return []
    signed = reduce(DataFrame.unionByName, [_signed(rows, sign) for rows, sign in ((come, 1), (gone, -1)) if rows is not None])
    keys = TABLES["starts"][1]
    add = store.put("starts", _sums(signed, keys).sortWithinPartitions(*keys), base)
    written = base | {"tables": {"starts": {ALL: [[v, n]] for _, _, v, n in add}}}
    days = _sums(store.read("starts", TABLES["starts"][0], written).withColumn("day", F.floor(F.col("started_at") / DAY_MS)), TABLES["days"][1])
    return add + store.put("days", days.coalesce(1), base)  # as many rows as a source has days


def touched_state(store: Store, base: dict, ids: DataFrame, buckets: set[str] | None = None) -> DataFrame:
    """``marked`` of some stored sessions (session_id), read from their buckets alone."""
    read = lambda t, s, key="session_id": store.read(t, s, base, buckets).join(ids.select(F.col("session_id").alias(key)).hint("merge"), key, "left_semi")
    return marked(read("sessions", SESSIONS, "id"), read("messages", MESSAGES), read("vectors", VECTORS), read("failures", FAILURES))


def recount(store: Store) -> dict:
    """Summaries made anew from all rows, in place of what is kept; Conflict if a run changes a session meanwhile."""
    base = store.manifest()
    read = lambda t, s: store.read(t, s, base)
    rows = marked(read("sessions", SESSIONS), read("messages", MESSAGES), read("vectors", VECTORS), read("failures", FAILURES))
    bare = base | {"tables": {t: parts for t, parts in base["tables"].items() if t not in TABLES and t != "sessions"}}
    remove = [(t, ALL, v) for t in TABLES for v, _ in base["tables"].get(t, {}).get(ALL, [])]
    return store.commit(base, deltas_of(store, bare, rows, None), remove, still=("sessions", "messages", "vectors", "failures", "tombstones", *TABLES))


def merge_counts(store: Store) -> dict:
    """Gather versions of like size into one each: sums of sums. Keys for which nothing is left disappear."""
    base, add, remove = store.manifest(), [], []
    for table, (schema, keys) in TABLES.items():
        held = base["tables"].get(table, {}).get(ALL, [])
        due = like_size(held)
        if due:
            some = base | {"tables": {table: {ALL: [v for v in held if v[0] in due]}}}
            add += store.put(table, _sums(store.read(table, schema, some), keys).repartitionByRange(*keys).sortWithinPartitions(*keys), base)
            remove += [(table, ALL, v) for v in due]
    return store.commit(base, add, remove) if remove else base


def _read(store: Store, table: str, manifest: dict, condition: Column) -> DataFrame:
    return store.read(table, TABLES[table][0], manifest).where(condition)


def in_hands(store: Store, manifest: dict, now_ms: int) -> tuple[DataFrame, DataFrame] | None:
    """(sessions, their state) of those a run has claimed and neither finished nor given back; None if there are none.

    As many as all runs hold at a time; their buckets alone are read."""
    claims = store.read("claims", CLAIMS, manifest)
    back = claims.where(F.col("until") < 0).select("session_id", "run")
    held = claims.where(F.col("until") > now_ms).join(back.hint("merge"), ["session_id", "run"], "left_anti").select("session_id").distinct()
    buckets = {r[0] for r in held.select(store.bucket("session_id", manifest)).distinct().collect()}  # at most as many as there are buckets
    if not buckets:
        return None
    status = touched_state(store, manifest, held, buckets).where(F.col("status") == "pending").select("id")
    sessions = store.read("sessions", SESSIONS, manifest, buckets).join(status, "id", "left_semi")
    return sessions, sessions.select(F.col("id").alias("session_id"), F.lit("processing").alias("status"))


def scope_metrics(store: Store, sources: list[str] | None = None, cutoff_ms: int | None = None, now_ms: int = 0, manifest: dict | None = None) -> DataFrame:
    """stats.scope_metrics of a stored scope: sessions, messages, total, done, processing, failed, pending and the title in work; one row."""
    manifest = manifest or store.manifest()
    if not kept(manifest):
        raise ValueError("this store keeps no summaries: recount() makes them")
    inside = F.col("source").isin(list(sources)) if sources else F.lit(True)
    if cutoff_ms is None:
        counted = _read(store, "days", manifest, inside).select(*COUNTS)
    else:
        day = cutoff_ms // DAY_MS
        edge = inside & (F.col("started_at") >= cutoff_ms) & (F.col("started_at") < (day + 1) * DAY_MS)
        counted = _read(store, "days", manifest, inside & (F.col("day") > day)).select(*COUNTS).unionByName(_read(store, "starts", manifest, edge).select(*COUNTS))
    one = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    held, processing, title = in_hands(store, manifest, now_ms), 0, None
    if held:
        within = inside if cutoff_ms is None else inside & (F.col("started_at") >= cutoff_ms)
        busy = held[0].where(within)
        processing, title = busy.count(), newest_processing_title(busy, held[1]).first()[0]
    number = lambda n: F.lit(n).cast("bigint")
    return one.select("sessions", "messages", F.col("sessions").alias("total"), "done", number(processing).alias("processing"), "failed", (F.col("pending") - number(processing)).alias("pending"), F.lit(title).cast("string").alias("processing_title"))


def source_summary(store: Store, manifest: dict | None = None) -> DataFrame:
    """stats.source_summary of the store, with done, failed and pending (sessions in hands among them): a row a source and one of totals."""
    manifest = manifest or store.manifest()
    if not kept(manifest):
        raise ValueError("this store keeps no summaries: recount() makes them")
    days = _sums(_read(store, "days", manifest, F.lit(True)), ["source", "day"])
    sums = days.groupBy("source").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("day").alias("first"), F.max("day").alias("last"))
    ends = F.lit(False)
    for r in sums.select("source", "first", "last").collect():  # a row a source
        if r["first"] is not None:
            at = F.col("started_at")
            of_day = lambda d: (at >= d * DAY_MS) & (at < (d + 1) * DAY_MS)  # noqa: B023, E731
            ends = ends | ((F.col("source") == r["source"]) & (of_day(r["first"]) | of_day(r["last"])))
    starts = _sums(_read(store, "starts", manifest, ends), ["source", "started_at"])
    extremes = starts.groupBy("source").agg(F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"))
    rows = sums.join(F.broadcast(extremes), "source", "left")  # a row a source
    total = rows.rollup("source").agg(*[F.sum(c).alias(c) for c in COUNTS], F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), F.grouping("source").alias("g"))
    return total.select(F.when(F.col("g") == 1, "total").otherwise(F.col("source")).alias("source"), "sessions", "messages", "oldest", "newest", *COUNTS[2:])


def source_report(store: Store, enabled: list[str], manifest: dict | None = None) -> DataFrame:
    """stats.source_report of the store, from what is kept."""
    on = F.col("source").isin(enabled) | (F.col("source") == "total")
    return source_summary(store, manifest).select("source", "sessions", "messages", date_range("oldest", "newest").alias("dates"), on.alias("enabled"), "done", "pending", "failed", percentage("done", "sessions").alias("done_pct"))
