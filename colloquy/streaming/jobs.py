"""The incremental jobs as streams: every micro-batch goes through the same merge as a batch run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.embed import embed_pending
from colloquy.operators.stats import embedding_state, work_list
from colloquy.operators.store import KEYS, Conflict, Store
from colloquy.operators.summaries import deltas_of, touched_state, unkept
from colloquy.operators.sync import CLAIM_SCHEMA, FAILURE_SCHEMA, MESSAGE_SCHEMA, SESSION_SCHEMA, VECTOR_SCHEMA, sync, sync_rows
from colloquy.sources.session_files import LAG_MS, SessionFiles, read_lines

#: Sessions taken at a time, and how long a claim holds.
SESSIONS, LEASE_MS = 10_000, 3_600_000


def sync_stream(spark: SparkSession, path: str, pattern: str, parse: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str, lag_ms: int = LAG_MS, **options) -> StreamingQuery:
    """Merge session files as they come or are rewritten, by the same plan as a batch run; one that a lost run has merged already is unchanged.

    parse gets lines (path, modified_ms, line_no, line; null where it isn't UTF-8) and gives event rows, or raw sessions with their messages as arrays."""
    spark.dataSource.register(SessionFiles)
    files = spark.readStream.format("session_files").option("path", path).option("pattern", pattern).option("recursive", "true").option("lag_ms", lag_ms).load()

    def merge(batch: DataFrame, _: int) -> None:
        found = parse(read_lines(batch, marked=True))
        (sync if "messages" in found.columns else sync_rows)(found, store, **options)

    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def claim(store: Store, run: str, now_ms: int, n: int = SESSIONS, lease_ms: int = LEASE_MS) -> DataFrame:
    """(session_id) of up to n sessions that the run has taken: pending, without a failure on record, in nobody's hands; last touched first.

    A claim is a row of the store. Two runs that reach for the same sessions touch the same buckets, so one commit fails and that run looks
    again; a claim that is not given back ends with its lease."""
    while True:
        base = store.manifest()
        state, state_path = store.aside(stored_state(store, base, now_ms).select("session_id", "status", "units_total"))
        sessions = store.read("sessions", SESSION_SCHEMA, base)
        taken, path = store.aside(work_list(sessions, state, n).select("session_id"))
        store.discard(state_path)
        if taken.isEmpty():
            return taken
        rows = taken.select("session_id", F.lit(run).alias("run"), F.lit(now_ms + lease_ms).cast("bigint").alias("until"))
        try:
            store.append({"claims": rows}, base)
            return taken
        except Conflict:
            store.discard(path)


def stored_state(store: Store, manifest: dict, now_ms: int) -> DataFrame:
    """Embedding state of all stored sessions, those in somebody's hands as processing."""
    read = lambda t, s: store.read(t, s, manifest)
    state = embedding_state(read("sessions", SESSION_SCHEMA), read("messages", MESSAGE_SCHEMA), read("vectors", VECTOR_SCHEMA), read("failures", FAILURE_SCHEMA))
    by_run = read("claims", CLAIM_SCHEMA).groupBy("session_id", "run").agg(F.max("until").alias("until"), F.min("until").alias("given_back"))
    held = by_run.where((F.col("until") > now_ms) & (F.col("given_back") >= 0)).select("session_id", F.lit(True).alias("held")).distinct()
    # sessions that are half done and in nobody's hands are pending again
    status = F.when(F.col("status").isin("done", "failed"), F.col("status")).when(F.col("held"), "processing").otherwise("pending")
    return state.join(held.hint("merge"), "session_id", "left").withColumn("status", status).drop("held")


def embed_run(store: Store, encoder=None, at_ms: int = 0, n: int = SESSIONS, lease_ms: int = LEASE_MS) -> int:
    """Embed what is pending, n sessions at a time: claim them, encode, commit vectors, failures and the claims' return in one manifest.

    A run that is lost keeps what it has committed, and its last claims end with their lease. A session with a failure on record is
    not taken up again until it is replaced. Gives the number of sessions worked on."""
    total = 0
    while True:
        run = uuid.uuid4().hex  # a name of its own for each claim, so one that is given back stays so
        taken = claim(store, run, at_ms, n, lease_ms)
        if taken.isEmpty():
            return total
        base = store.manifest()
        # a replaced session's claim is dead
        mine, mine_path = store.aside(taken.join(store.read("claims", CLAIM_SCHEMA, base).where(F.col("run") == run).select("session_id").distinct().hint("merge"), "session_id", "left_semi"))
        sessions, messages = store.read("sessions", SESSION_SCHEMA, base), store.read("messages", MESSAGE_SCHEMA, base).join(mine.hint("merge"), "session_id", "left_semi")
        done, path = store.aside(embed_pending(sessions, messages, store.read("vectors", VECTOR_SCHEMA, base), encoder))
        good, bad = done.where(F.col("error").isNull()), done.where(F.col("error").isNotNull())
        back = taken.select("session_id", F.lit(run).alias("run"), F.lit(-1).cast("bigint").alias("until"))
        tables = {"vectors": good.select("message_id", "embedding", "session_id"), "failures": bad.select("session_id", "message_id", "error", F.lit(at_ms).cast("bigint").alias("at")), "claims": back}
        add = [v for name, rows in tables.items() for v in store.put(name, rows, base)]
        before, before_path = store.aside(touched_state(store, base, mine))
        tried = done.groupBy(F.col("session_id").alias("id")).agg(F.count_if(F.col("error").isNotNull()).alias("lost"))
        # all that was pending has been tried: a session is done unless one of its texts has failed
        status = F.when(F.col("lost") > 0, "failed").when(F.col("lost") == 0, "done").otherwise(F.col("status"))
        add += deltas_of(store, base, before.join(tried.hint("merge"), "id", "left").withColumn("status", status), before)
        try:
            store.commit(base, add, touched={b for t, b, *_ in add if t in KEYS}, still=unkept(base))
            total += taken.count()
        except Conflict:  # a bucket has changed meanwhile: give the sessions back and take what is pending then
            store.append({"claims": back})
        for at in (before_path, path, mine_path):
            store.discard(at)
