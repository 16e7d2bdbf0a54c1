"""Incremental merge of scanned sessions into the stored tables.

Sessions are unique by (source, source_id); one that is missing from a scan stays. See ``store`` for how tables are merged on read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import first_user_message, is_noise, title
from colloquy.operators.filters import within_window
from colloquy.operators.index import merge_segments, segment_of
from colloquy.operators.store import KEYS, UNINDEXED, Store
from colloquy.operators.summaries import deltas_of, kept, marked, merge_counts, touched_state, unkept
from colloquy.sources.rows import heads, number

SESSION_SCHEMA = "id string, source string, source_id string, title string, directory string, started_at bigint, updated_at bigint, message_count int, entrypoint string"
MESSAGE_SCHEMA = "message_id bigint, session_id string, role string, content string, timestamp bigint, seq int"
RAW_SCHEMA = "source string, source_id string, directory string, started_at bigint, updated_at bigint, entrypoint string, listing bigint, messages array<struct<role:string,content:string,timestamp:bigint>>"


def _size(entries: DataFrame) -> Column:
    """Messages of an entry, which has them as an array or counts them."""
    return F.size("messages") if "messages" in entries.columns else F.col("n_messages")


def session_id(source: str = "source", source_id: str = "source_id") -> Column:
    """A derived key, the same in every run."""
    return F.sha2(F.concat_ws("\n", source, source_id), 256)


WRITTEN = ("new", "updated", "reprocessed")


def _followed(raw: DataFrame, stored: DataFrame, cutoff_ms: int | None, force: bool) -> DataFrame:
    """Entries with their action and whether they stand in the end: each is compared with what its key holds after the entries before it.

    Entries outside the window count for nothing. Changed: another message count, or an update time that is there and differs."""
    known = stored.select("source", "source_id", F.struct(F.lit(True).alias("known"), F.col("updated_at").alias("at"), F.col("message_count").cast("int").alias("n")).alias("held"))
    order = Window.partitionBy("source", "source_id").orderBy("listing", "updated_at", _size(raw))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct(F.col("updated_at").alias("at"), _size(raw).alias("n"), (~F.coalesce(within_window(cutoff_ms), F.lit(False))).alias("out"))
    # times and counts alone are gathered, not messages
    listed = raw.withColumn("place", F.row_number().over(order)).withColumn("entries", F.collect_list(entry).over(every)).join(known.hint("merge"), ["source", "source_id"], "left")
    start = F.struct(F.coalesce("held.known", F.lit(False)).alias("known"), F.col("held.at").alias("at"), F.coalesce("held.n", F.lit(-1)).alias("n"), F.array().cast("array<string>").alias("actions"))

    def follow(state: Column, x: Column) -> Column:
        changed = (x["n"] != state["n"]) | (x["at"].isNotNull() & ~x["at"].eqNullSafe(state["at"]))
        action = F.when(x["out"], "filtered").when(~state["known"], "new").when(changed, "updated").otherwise("reprocessed" if force else "unchanged")
        written = action.isin(*WRITTEN)
        return F.struct((state["known"] | written).alias("known"), F.when(written, x["at"]).otherwise(state["at"]).alias("at"), F.when(written, x["n"]).otherwise(state["n"]).alias("n"), F.array_append(state["actions"], action).alias("actions"))

    done = listed.withColumn("actions", F.aggregate("entries", start, follow)["actions"])
    last = F.array_max(F.transform("actions", lambda a, i: F.when(a.isin(*WRITTEN), i + 1)))
    return done.withColumn("action", F.get("actions", F.col("place") - 1)).withColumn("stands", F.coalesce(F.col("place") == last, F.lit(False))).drop("place", "entries", "held", "actions")


def nothing_stored(raw: DataFrame) -> DataFrame:
    return raw.sparkSession.createDataFrame([], SESSION_SCHEMA)


def last_differing(raw: DataFrame) -> DataFrame:
    """One entry for each key: of entries that differ from the last one kept (another count, or another time that is there) the last."""
    return _followed(raw, nothing_stored(raw), None, False).where("stands").drop("action", "stands")


def last_entry(raw: DataFrame) -> DataFrame:
    """One entry for each key: the last, outright (forced runs)."""
    return _followed(raw, nothing_stored(raw), None, True).where("stands").drop("action", "stands")


def plan(raw: DataFrame, stored: DataFrame, cutoff_ms: int | None = None, force: bool = False) -> DataFrame:
    """Scanned entries with the action each calls for (filtered, new, updated, reprocessed or unchanged), and whether the entry stands after the run."""
    return _followed(raw, stored, cutoff_ms, force)


def tabular_changes(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Of a tabular source's sessions (source_id, updated_at, message_count), those that are new or changed, before any message is read."""
    known = stored.select("source_id", F.col("updated_at").alias("stored_at"), F.col("message_count").alias("stored_count"))
    same = F.col("updated_at").eqNullSafe(F.col("stored_at")) & (F.col("message_count") == F.col("stored_count"))
    return listed.join(known, "source_id", "left").where(~F.coalesce(same, F.lit(False))).drop("stored_at", "stored_count")


def counters(planned: DataFrame) -> DataFrame:
    """(action, sessions, messages) of a plan."""
    return planned.groupBy("action").agg(F.count("*").alias("sessions"), F.sum(_size(planned)).alias("messages"))


def message_rows(planned: DataFrame) -> DataFrame:
    """Messages of planned entries, numbered from 0 in their order; ids derived from session and number."""
    rows = planned.select(session_id().alias("session_id"), F.posexplode("messages").alias("seq", "m"))
    return rows.select(F.xxhash64("session_id", "seq").alias("message_id"), "session_id", "m.role", "m.content", "m.timestamp", F.col("seq").cast("int").alias("seq"))


def numbered_rows(events: DataFrame, planned: DataFrame) -> DataFrame:
    """Messages of planned entries from their event rows, as message_rows."""
    rows = number(events, planned.select("source", "entry", session_id().alias("session_id")))
    return rows.select(F.xxhash64("session_id", "seq").alias("message_id"), "session_id", "role", "content", "timestamp", "seq")


def session_rows(planned: DataFrame) -> DataFrame:
    """Session rows of planned entries: title and count from their messages, without a second pass over them."""
    if "messages" in planned.columns:
        user = F.filter("messages", lambda m: m["role"] == "user")
        telling = F.filter(user, lambda m: ~is_noise(m["content"]))
        first = F.coalesce(F.get(telling, 0)["content"], F.get(user, 0)["content"])
    else:
        first = F.col("first_text")
    return planned.select(session_id().alias("id"), "source", "source_id", title(first).alias("title"), "directory", "started_at", "updated_at", _size(planned).alias("message_count"), "entrypoint")


def titles(messages: DataFrame) -> DataFrame:
    """(session_id, title) from message rows."""
    return messages.groupBy("session_id").agg(first_user_message().alias("first")).select("session_id", title("first").alias("title"))


def replace_rows(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of new in place of those with the same keys."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_sessions(ids: DataFrame, sessions: DataFrame, messages: DataFrame, vectors: DataFrame, state: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables without the sessions of the ids, their messages, vectors and state."""
    gone = ids.select("session_id").distinct()
    lost = messages.join(gone, "session_id", "left_semi").select("message_id")
    out = {"sessions": sessions.join(gone, sessions["id"] == gone["session_id"], "left_anti"), "messages": messages.join(gone, "session_id", "left_anti"), "vectors": vectors.join(lost, "message_id", "left_anti")}
    return out | ({"state": state.join(gone, "session_id", "left_anti")} if state is not None else {})


def merge(planned: DataFrame, sessions: DataFrame, messages: DataFrame, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables after a plan: entries that stand replace what is stored of their sessions, messages too; vectors of replaced messages go."""
    todo = planned.where("stands")
    fresh = session_rows(todo)
    keys = ["source", "source_id"]
    ids = sessions.join(fresh.select(*keys), keys, "left_semi").select(F.col("id").alias("session_id"))
    out = {"sessions": replace_rows(sessions, fresh, keys), "messages": messages.join(ids, "session_id", "left_anti").unionByName(message_rows(todo))}
    if vectors is not None:
        lost = messages.join(ids, "session_id", "left_semi").select("message_id")
        out["vectors"] = vectors.join(lost, "message_id", "left_anti")
    return out


VECTOR_SCHEMA = "message_id bigint, embedding array<float>"


JOB_SCHEMA = "job string, phase string, detail string, updated_at bigint"
CLAIM_SCHEMA = "session_id string, run string, until bigint"
FAILURE_SCHEMA = "session_id string, message_id bigint, error string, at bigint"
#: Tables as they are stored, besides the index.
STORED = {"sessions": SESSION_SCHEMA, "messages": MESSAGE_SCHEMA, "vectors": f"{VECTOR_SCHEMA}, session_id string", "failures": FAILURE_SCHEMA, "claims": CLAIM_SCHEMA, "codes": "message_id bigint, cell int, code binary, bias float, session_id string", "job_log": JOB_SCHEMA}


def _followed_by(store: Store, base: dict, replaced: DataFrame, add: list[tuple]) -> list[tuple]:
    """Versions that go with the sessions and messages just written, in place of replaced sessions (session_id): tombstones, a segment of the keyword index, summaries."""
    written = base | {"tables": {t: {b: [[v, n]] for x, b, v, n in add if x == t} for t in ("sessions", "messages")}}
    read = lambda t, s: store.read(t, s, written)  # noqa: E731  as just written, not parsed again
    new, out, old, gone, paths = read("messages", MESSAGE_SCHEMA), [], None, None, []

    def counted(state: DataFrame) -> DataFrame:
        """What sessions count as, written aside: a plan with the state of all that come and go has hundreds of nodes, which the driver plans anew after each stage."""
        rows, path = store.aside(state)
        paths.append(path)
        return rows

    come = counted(marked(read("sessions", SESSION_SCHEMA), new, read("vectors", VECTOR_SCHEMA))) if add and kept(base) else None
    if not replaced.isEmpty():
        out += store.put("tombstones", replaced, base) + store.put(UNINDEXED, replaced, base)
        buckets = {r[0] for r in replaced.select(store.bucket("session_id", base)).distinct().collect()}  # at most as many as there are buckets
        old = store.read("messages", MESSAGE_SCHEMA, base, buckets).join(replaced.hint("merge"), "session_id", "left_semi")
        gone = counted(touched_state(store, base, replaced, buckets)) if kept(base) else None
    out += segment_of(store, base, new, old) + deltas_of(store, base, come, gone)
    for path in paths:
        store.discard(path)
    return out


def delete_stored(store: Store, ids: DataFrame) -> int:
    """Sessions (session_id) leave the store, with their messages, vectors, failures and claims, the index and the summaries; gives how many there were."""
    base = store.manifest()
    known = store.read("sessions", SESSION_SCHEMA, base).join(ids.select(F.col("session_id").alias("id")).hint("merge"), "id", "left_semi")
    gone, path = store.aside(known.select(F.col("id").alias("session_id")))
    n = gone.count()
    if n:
        add = _followed_by(store, base, gone, [])
        store.commit(base, add, touched={b for t, b, *_ in add if t in KEYS}, still=unkept(base))
    store.discard(path)
    return n


def sync(raw: DataFrame, store: Store, cutoff_ms: int | None = None, force: bool = False, enabled: list[str] | None = None, pruned: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """One run over scanned entries: plan, write what changes, commit; gives the counters, with those of files pruned before (action, sessions).

    What is scanned is parsed once. With event rows, raw holds entries without their messages (see sync_rows). A run writes the new rows, tombstones of the sessions they replace, and a segment of the keyword
    index; nothing that is stored is rewritten here (see upkeep). Vectors and failures of replaced sessions are dead with their messages."""
    scanned = raw.where(F.col("source").isin(enabled)) if enabled else raw
    base = store.manifest()
    sessions = store.read("sessions", SESSION_SCHEMA, base)
    planned, path = store.aside(plan(scanned, sessions, cutoff_ms, force))
    done = counters(planned)
    if pruned is not None:
        done = done.unionByName(pruned.withColumn("messages", F.lit(0).cast("bigint"))).groupBy("action").agg(F.sum("sessions").alias("sessions"), F.sum("messages").alias("messages"))
    rows = done.collect()  # at most five actions
    todo = planned.where("stands")
    if any(r["action"] in WRITTEN for r in rows):
        known = sessions.join(todo.select("source", "source_id").hint("merge"), ["source", "source_id"], "left_semi").select(F.col("id").alias("session_id"))
        replaced, replaced_path = store.aside(known)
        add = store.put("sessions", session_rows(todo), base) + store.put("messages", message_rows(todo) if events is None else numbered_rows(events, todo), base)
        add += _followed_by(store, base, replaced, add)
        store.commit(base, add, touched={b for t, b, *_ in add if t in KEYS}, still=unkept(base))
        store.discard(replaced_path)
    store.discard(path)
    return store.spark.createDataFrame(rows, done.schema)


def sync_rows(events: DataFrame, store: Store, cutoff_ms: int | None = None, force: bool = False, enabled: list[str] | None = None, pruned: DataFrame | None = None) -> DataFrame:
    """One run over sessions that come as event rows, as sync(): rows are written aside once, entries are planned without their messages."""
    staged, path = store.aside(events.where(F.col("source").isin(enabled)) if enabled else events)
    done = sync(heads(staged), store, cutoff_ms, force, pruned=pruned, events=staged)
    store.discard(path)
    return done


def upkeep(store: Store, keep: int = 3, age_ms: int = 86_400_000) -> None:
    """Gather what runs have added: buckets that have grown by as much as they held, segments and counts of like size; then drop what no manifest names."""
    store.compact(STORED)
    merge_segments(store)
    merge_counts(store)
    store.vacuum(keep, age_ms)


def append_job_phase(store: Store, job: str, phase: str, detail: str | None, at_ms: int) -> None:
    """A row of the run log."""
    store.append({"job_log": store.spark.createDataFrame([(job, phase, detail, at_ms)], JOB_SCHEMA)})


def job_state(log: DataFrame) -> DataFrame:
    """(job, phase, detail, updated_at): the last phase of each job; a cleared job (phase null) has none."""
    last = log.groupBy("job").agg(F.max_by(F.struct("phase", "detail", "updated_at"), "updated_at").alias("last"))
    return last.select("job", "last.*").where(F.col("phase").isNotNull())
