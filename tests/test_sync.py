import pytest
from pyspark.sql import functions as F

from colloquy.operators import embed, stats, sync
from colloquy.streaming import jobs


def raw(spark, *rows):
    """(source_id, updated_at, texts, listing)"""
    data = [("codex", i, None, 1000, u, None, n, [("user", t, None) for t in texts]) for i, u, texts, n in rows]
    return spark.createDataFrame(data, sync.RAW_SCHEMA)


def actions(planned):
    return {r["source_id"]: r["action"] for r in planned.collect()}


def followed(planned):
    """(action, stands) of a key's entries in their order."""
    return [(r["action"], r["stands"]) for r in sorted(planned.collect(), key=lambda r: r["listing"])]


def stored(spark, *rows):
    return spark.createDataFrame([(f"x-{i}", "codex", i, "t", None, 1000, u, n, None) for i, u, n in rows], sync.SESSION_SCHEMA)


@pytest.mark.parametrize(
    "have, scanned, want",
    [((2000, 2), (3000, 5), "updated"), ((2000, 3), (5000, 3), "updated"), ((2000, 2), (2000, 2), "unchanged"), ((2000, 2), (None, 2), "unchanged"), ((None, 2), (None, 2), "unchanged"), ((2000, 2), (None, 3), "updated")],
)
def test_change_detection(spark, have, scanned, want):
    planned = sync.plan(raw(spark, ("a", scanned[0], ["m"] * scanned[1], 0)), stored(spark, ("a", *have)))
    assert actions(planned) == {"a": want}
    forced = sync.plan(raw(spark, ("a", scanned[0], ["m"] * scanned[1], 0)), stored(spark, ("a", *have)), force=True)
    assert actions(forced) == {"a": want if want != "unchanged" else "reprocessed"}


def test_window_and_new(spark):
    planned = sync.plan(raw(spark, ("old", 10, ["m"], 0), ("new", None, ["m"], 1)), stored(spark), cutoff_ms=500)
    assert actions(planned) == {"old": "filtered", "new": "new"}


def test_the_last_differing_entry_wins(spark):
    rows = raw(spark, ("a", 1, ["x"], 0), ("a", 2, ["y"], 1), ("a", 2, ["z"], 2), ("a", None, ["w"], 3))
    assert sync.last_differing(rows).first()["messages"][0]["content"] == "y"
    assert sync.last_entry(rows).first()["messages"][0]["content"] == "w"


def test_entries_are_compared_with_what_is_kept(spark):
    one = lambda *rows: raw(spark, *[("a", u, texts, n) for n, (u, texts) in enumerate(rows)])
    # the third has the time of the first, which is kept: the second has none
    assert sync.last_differing(one((1, ["x"]), (None, ["y"]), (1, ["z"]))).first()["messages"][0]["content"] == "x"
    assert followed(sync.plan(one((1, ["x"]), (None, ["y"]), (1, ["z"])), stored(spark))) == [("new", True), ("unchanged", False), ("unchanged", False)]
    # what is stored changes and changes back: the last is written
    assert followed(sync.plan(one((6, ["x"]), (5, ["y"])), stored(spark, ("a", 5, 1)))) == [("updated", False), ("updated", True)]
    # entries outside the window count for nothing
    assert followed(sync.plan(one((900, ["x"]), (2, ["y"])), stored(spark), cutoff_ms=500)) == [("new", True), ("filtered", False)]
    assert followed(sync.plan(one((5, ["x"]), (5, ["y"])), stored(spark, ("a", 5, 1)), force=True)) == [("reprocessed", False), ("reprocessed", True)]


def test_vectors_of_replaced_messages_go_with_them(spark, tmp_path):
    store = sync.Store(spark, str(tmp_path))
    sync.sync(raw(spark, ("a", 1, ["first text"], 0), ("b", 1, ["other text"], 1)), store)
    jobs.embed_run(store)
    before = {r["message_id"]: r["embedding"] for r in store.read("vectors", jobs.VECTOR_SCHEMA).collect()}
    sync.sync(raw(spark, ("a", 2, ["second words"], 0)), store)
    left = {r["message_id"] for r in store.read("vectors", jobs.VECTOR_SCHEMA).collect()}
    changed = (set(before) - left).pop()
    assert len(before) == 2 and len(left) == 1
    jobs.embed_run(store)
    after = {r["message_id"]: r["embedding"] for r in store.read("vectors", jobs.VECTOR_SCHEMA).collect()}
    assert after.keys() == before.keys() and after[changed] != before[changed]


def test_claimed_sessions_are_in_work(spark):
    sessions = stored(spark, ("a", 5, 1), ("b", 9, 1), ("c", 7, 1))
    state = spark.createDataFrame([("x-a", 2, "pending", None), ("x-b", 1, "failed", "e"), ("x-c", 3, "pending", "old")], "session_id string, units_total int, status string, last_error string")
    taken, after = stats.claim(sessions, state, 1)
    assert [tuple(r) for r in taken.collect()] == [("x-c", "t", 3)]
    assert {r["session_id"]: (r["status"], r["last_error"]) for r in after.collect()} == {"x-a": ("pending", None), "x-b": ("failed", "e"), "x-c": ("processing", None)}
    assert stats.is_embedded(after) and not stats.is_embedded(state)


def test_runs_are_idempotent_and_nothing_is_deleted(spark, tmp_path):
    store = sync.Store(spark, str(tmp_path))
    count = lambda d: {r["action"]: r["sessions"] for r in d.collect()}
    assert count(sync.sync(raw(spark, ("a", 1, ["x", "y"], 0), ("b", 1, ["z"], 1)), store)) == {"new": 2}
    before = sorted(map(tuple, store.read("messages", sync.MESSAGE_SCHEMA).collect()))
    assert count(sync.sync(raw(spark, ("a", 1, ["x", "y"], 0), ("b", 1, ["z"], 1)), store)) == {"unchanged": 2}
    assert sorted(map(tuple, store.read("messages", sync.MESSAGE_SCHEMA).collect())) == before
    assert count(sync.sync(raw(spark, ("a", 2, ["x2"], 0)), store)) == {"updated": 1}
    sessions = {r["source_id"]: r for r in store.read("sessions", sync.SESSION_SCHEMA).collect()}
    assert sessions.keys() == {"a", "b"} and sessions["a"]["title"] == "x2" and sessions["a"]["message_count"] == 1
    assert {r["content"] for r in store.read("messages", sync.MESSAGE_SCHEMA).collect()} == {"x2", "z"}


def test_deletion_takes_messages_and_vectors(spark):
    sessions = stored(spark, ("a", 1, 1), ("b", 1, 1))
    messages = spark.createDataFrame([(1, "x-a", "user", "m", None, 0), (2, "x-b", "user", "m", None, 0)], sync.MESSAGE_SCHEMA)
    vectors = spark.createDataFrame([(1, [0.1]), (2, [0.1])], jobs.VECTOR_SCHEMA)
    left = sync.delete_sessions(spark.createDataFrame([("x-a",)], "session_id string"), sessions, messages, vectors)
    assert {k: d.count() for k, d in left.items()} == {"sessions": 1, "messages": 1, "vectors": 1}
    assert left["vectors"].first()["message_id"] == 2


def test_vector_upsert(spark):
    vectors = spark.createDataFrame([(1, [0.5]), (2, [0.5])], jobs.VECTOR_SCHEMA)
    for _ in range(2):
        vectors = embed.upsert_vectors(vectors, spark.createDataFrame([(2, [1.0]), (3, [1.0])], jobs.VECTOR_SCHEMA))
    assert {r[0]: r[1] for r in vectors.collect()} == {1: [0.5], 2: [1.0], 3: [1.0]}


def test_embedding_run_and_states(spark, tmp_path):
    store = sync.Store(spark, str(tmp_path))
    sync.sync(raw(spark, ("a", 1, ["one text", "boom text"], 0), ("b", 1, ["hi"], 1), ("c", 1, ["fine text"], 2)), store)

    def encoder(texts):
        if any("boom" in t for t in texts):
            raise ValueError("boom")
        return embed.HashedTerms(8)(texts)

    jobs.embed_run(store, encoder)
    sessions, messages = store.read("sessions", sync.SESSION_SCHEMA), store.read("messages", sync.MESSAGE_SCHEMA)
    vectors = store.read("vectors", jobs.VECTOR_SCHEMA)
    failed = store.read("failures", sync.FAILURE_SCHEMA)
    state = stats.embedding_state(sessions, messages, vectors, failed).join(sessions.select(F.col("id").alias("session_id"), "source_id"), "session_id")
    assert {r["source_id"]: (r["status"], r["units_done"], r["units_total"]) for r in state.collect()} == {"a": ("failed", 1, 2), "b": ("done", 0, 0), "c": ("done", 1, 1)}
    one = stats.embedding_progress(sessions, state).first()
    assert one["total"] == sum(one[k] for k in ("done", "processing", "failed", "pending")) == 3
    jobs.embed_run(store)  # a failed session is left alone, with an encoder that would do
    assert store.read("vectors", jobs.VECTOR_SCHEMA).count() == 2 and store.read("failures", sync.FAILURE_SCHEMA).count() == 1
    sync.sync(raw(spark, ("a", 2, ["one text", "calm text"], 0)), store)  # until it is replaced
    assert store.read("failures", sync.FAILURE_SCHEMA).count() == 0
    jobs.embed_run(store, at_ms=7, n=1)
    assert store.read("vectors", jobs.VECTOR_SCHEMA).count() == 3


def test_job_log(spark, tmp_path):
    store = sync.Store(spark, str(tmp_path))
    for row in (("sync", "scan", "codex", 1), ("sync", "merge", None, 2), ("embed", "run", None, 1), ("embed", None, None, 3)):
        sync.append_job_phase(store, *row)
    assert [tuple(r) for r in sync.job_state(store.read("job_log", sync.JOB_SCHEMA)).collect()] == [("sync", "merge", None, 2)]


def test_pruning_before_parsing(spark):
    from colloquy.sources.files import prune

    listed = spark.createDataFrame([("p1", 5, "a"), ("p2", 50, "b"), ("p3", 60, "c"), ("p4", 70, "d")], "path string, modified_ms bigint, source_id string")
    got = prune(listed, stored(spark, ("b", 50, 1), ("c", 1, 1)), cutoff_ms=10)
    assert {r["source_id"]: r["scan"] for r in got.collect()} == {"a": "filtered", "b": "skipped", "c": "parse", "d": "parse"}
