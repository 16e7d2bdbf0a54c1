import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import DAY_MS
from colloquy.operators import embed, stats, summaries, sync
from colloquy.operators.store import Conflict, Store
from colloquy.streaming import jobs

SOURCES = ("codex", "cursor", "kiro-cli")


def raw(spark, *rows):
    """(source, source_id, started_at, updated_at, texts)"""
    data = [(s, i, None, at, u, None, n, [("user", t, None) for t in texts]) for n, (s, i, at, u, texts) in enumerate(rows)]
    return spark.createDataFrame(data, sync.RAW_SCHEMA)


def unsteady(texts):
    if any("bad" in t for t in texts):
        raise ValueError("no luck")
    return embed.HashedTerms(8)(texts)


def table(df):
    return sorted(map(str, df.collect()))


def check(store, now_ms, scopes=((None, None), (["cursor", "codex"], 5 * DAY_MS + 7))):
    """Every summary equals recomputation, row by row, from what is stored."""
    manifest = store.manifest()
    state = jobs.stored_state(store, manifest, now_ms).withColumnRenamed("session_id", "id")
    messages = stats.messages_per_session(store.read("messages", sync.MESSAGE_SCHEMA, manifest)).withColumnRenamed("session_id", "id")
    rows = store.read("sessions", sync.SESSION_SCHEMA, manifest).join(state, "id").join(messages, "id").collect()
    for sources, cutoff in scopes:
        scope = [r for r in rows if (sources is None or r["source"] in sources) and (cutoff is None or r["started_at"] is not None and r["started_at"] >= cutoff)]
        n = Counter(r["status"] for r in scope)
        busy = max(((r["updated_at"], r["id"], r["title"]) for r in scope if r["status"] == "processing"), default=(None,))[-1]
        want = {"sessions": len(scope), "messages": sum(r["n_messages"] for r in scope), "total": len(scope), "processing_title": busy} | {k: n[k] for k in ("done", "processing", "failed", "pending")}
        assert summaries.scope_metrics(store, sources, cutoff, now_ms).first().asDict() == want, (sources, cutoff)
    want = []
    for source in [*{r["source"] for r in rows}, "total"]:
        scope = [r for r in rows if source in (r["source"], "total")]
        n, times = Counter(r["status"] for r in scope), [r["started_at"] for r in scope if r["started_at"] is not None]
        want.append((source, len(scope), sum(r["n_messages"] for r in scope), min(times, default=None), max(times, default=None), n["done"], n["failed"], n["pending"] + n["processing"]))
    assert sorted(map(tuple, summaries.source_summary(store).collect())) == sorted(want)


def test_summaries_equal_recomputation_after_random_runs(spark, tmp_path):
    """New, replaced and deleted sessions, runs that embed and fail, sessions in somebody's hands, compaction, no time of start."""
    rng = random.Random(5)
    store = Store(spark, str(tmp_path), bucket_bytes=12_000)
    say = lambda: [rng.choice(["some words", "bad luck", "x", "more of it"]) for _ in range(rng.randrange(1, 5))]
    for run in range(3):
        some = {rng.randrange(20) for _ in range(9)}
        times = lambda i: None if i == 7 else (i % 9) * DAY_MS + i + run * (i % 2)
        sync.sync(raw(spark, *[(SOURCES[i % 3], f"s{i}", times(i), run + 1, say()) for i in some]), store)
        if run == 1:
            jobs.embed_run(store, unsteady, at_ms=run, n=4)
        if run == 2:
            ids = store.read("sessions", sync.SESSION_SCHEMA).orderBy("started_at").limit(4).select(F.col("id").alias("session_id"))
            assert sync.delete_stored(store, ids) == 4
            assert sync.delete_stored(store, ids.limit(0)) == 0
            jobs.claim(store, "run", 100, n=3, lease_ms=50)
            sync.upkeep(store, keep=1, age_ms=0)
        if run:
            check(store, 120)
    check(store, 151, [(None, None)])
    jobs.embed_run(store, unsteady, at_ms=200)
    sync.upkeep(store, keep=1, age_ms=0)
    check(store, 201, [(None, None), (["opencode"], None), (None, 0), (["codex"], 3 * DAY_MS), (None, 40 * DAY_MS)])
    before = table(summaries.source_summary(store))
    assert summaries.scope_metrics(store).first()["failed"] > 0
    summaries.recount(store)
    assert table(summaries.source_summary(store)) == before


def test_deleted_sessions_leave_index_and_tables(spark, tmp_path):
    from colloquy.operators import index, search

    store = Store(spark, str(tmp_path))
    sync.sync(raw(spark, *[("codex", f"s{i}", i, 1, [f"alpha beta{i % 2}", "gamma"]) for i in range(6)]), store)
    jobs.embed_run(store, embed.HashedTerms(8))
    ids = store.read("sessions", sync.SESSION_SCHEMA).where("started_at < 3").select(F.col("id").alias("session_id"))
    assert sync.delete_stored(store, ids.unionByName(spark.createDataFrame([("nobody",)], "session_id string"))) == 3
    sessions, messages = store.read("sessions", sync.SESSION_SCHEMA), store.read("messages", sync.MESSAGE_SCHEMA)
    assert sessions.count() == 3 and messages.count() == 6 == store.read("vectors", sync.VECTOR_SCHEMA).count()
    assert index.stored_counts(store, ["alpha", "gamma"])[2] == {"alpha": 3, "gamma": 3}
    assert table(index.search_index(store, sessions, messages, "alpha beta1")) == table(search.fts_search(sessions, messages, "alpha beta1"))
    sync.sync(raw(spark, ("codex", "s0", 0, 1, ["alpha again"])), store)  # a deleted one can come back
    assert store.read("sessions", sync.SESSION_SCHEMA).count() == 4
    check(store, 0, [(None, 2)])


def test_an_empty_store_and_one_without_summaries(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert summaries.scope_metrics(store).first().asDict() == {"sessions": 0, "messages": 0, "total": 0, "done": 0, "processing": 0, "failed": 0, "pending": 0, "processing_title": None}
    sync.sync(raw(spark, ("codex", "a", 1, 1, ["some text"])), store)
    base = store.manifest()
    store.commit(base, [], [(t, "all", v) for t in summaries.TABLES for v, _ in base["tables"][t]["all"]])
    late = store.manifest()
    late["tables"] = {t: parts for t, parts in late["tables"].items() if t not in summaries.TABLES}  # as it was before there were any
    assert not summaries.kept(late) and summaries.unkept(late) == ("starts",)
    with pytest.raises(ValueError):
        summaries.scope_metrics(store, manifest=late)
    summaries.recount(store)
    check(store, 0, [(None, None)])
    with pytest.raises(Conflict):  # a run begun without summaries must not end beside new ones
        store.commit(late, [], still=summaries.unkept(late))


def test_a_run_reads_and_writes_little(spark, tmp_path):
    """A changed session costs some rows of counts; summaries read no sessions."""
    store = Store(spark, str(tmp_path))
    sync.sync(raw(spark, *[(SOURCES[i % 3], f"s{i}", i * DAY_MS, 1, ["word"] * 3) for i in range(60)]), store)
    sync.sync(raw(spark, ("codex", "s3", 3 * DAY_MS, 2, ["word"])), store)
    last = store.manifest()["tables"]["starts"]["all"][-1:]
    only = store.manifest() | {"tables": {"starts": {"all": last}}}
    assert [r.asDict() for r in store.read("starts", summaries.TABLES["starts"][0], only).collect()] == [{"source": "codex", "started_at": 3 * DAY_MS, "sessions": 0, "messages": -2, "done": 0, "failed": 0, "pending": 0}]
    files = summaries.source_summary(store).inputFiles() + summaries.scope_metrics(store, ["codex"], DAY_MS + 5).inputFiles()
    assert files and all("/days/" in f or "/starts/" in f for f in files)
