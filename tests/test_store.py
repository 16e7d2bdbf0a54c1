import os
import random

import pytest

from colloquy.operators import codes, embed, index, search, sync
from colloquy.operators.store import Conflict, Store
from colloquy.plans import stored
from colloquy.streaming import jobs
from tests.test_sync import raw

WORDS = ["the", "the", "the", "of", "alpha", "beta", "gamma_ray", "Délta", "omega", "snake case"]


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


def rows(df):
    return sorted(map(str, df.collect()))


def state(store, manifest=None):
    return [rows(store.read(t, s, manifest)) for t, s in (("sessions", sync.SESSION_SCHEMA), ("messages", sync.MESSAGE_SCHEMA))]


def texts(rng):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 5))]


def test_random_runs_equal_one_full_rebuild(spark, tmp_path):
    """Rows, keyword lists and statistics after runs with replaced sessions, compactions and splits are those of a store made in one go."""
    rng, last = random.Random(11), {}
    store = Store(spark, str(tmp_path / "grown"), bucket_bytes=12_000)
    for run in range(5):
        some = [(f"s{rng.randrange(25)}", run + 1, texts(rng), n) for n in range(12)]
        sync.sync(raw(spark, *some), store)
        for s in some:
            if s[0] not in last or last[s[0]][1] != s[1] or len(last[s[0]][2]) != len(s[2]):
                last[s[0]] = s
        if run in (1, 3):
            sync.upkeep(store, keep=2, age_ms=0)
    manifest = store.manifest()
    assert len(set(manifest["slots"])) > 1  # the directory has grown
    once = Store(spark, str(tmp_path / "once"))
    sync.sync(raw(spark, *last.values()), once)
    assert state(store) == state(once)
    sessions, messages = (store.read(t, s) for t, s in (("sessions", sync.SESSION_SCHEMA), ("messages", sync.MESSAGE_SCHEMA)))
    lengths = search.build_lengths(messages)
    counts = {r["term"]: r["count"] for r in search.build_postings(messages).groupBy("term").count().collect()}
    assert index.stored_counts(store, sorted(counts)) == (*search.corpus_stats(lengths), counts)
    for query in ("the of", "alpha the snake_case", "gamma_ray délta", "omega omega beta", "nothing", "--"):
        for fetch in (3, 60):
            want = rows(search.fts_search(sessions, messages, query, fetch))
            assert rows(index.search_index(store, sessions, messages, query, fetch)) == want
            assert rows(index.search_index(store, sessions, messages, query, fetch, bounded=False)) == want
    only = sessions.started_at >= 0
    assert rows(index.search_index(store, sessions, messages, "the", 4, condition=only)) == rows(search.fts_search(sessions, messages, "the", 4, condition=only))


def test_a_run_writes_what_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rng = random.Random(2)
    sync.sync(raw(spark, *[(f"s{i}", 1, texts(rng) * 40, i) for i in range(120)]), store)
    first = written(tmp_path)
    sync.sync(raw(spark, ("s3", 2, ["new"], 0)), store)
    assert written(tmp_path) - first < first / 4 and store.manifest()["number"] == 2
    sync.sync(raw(spark, ("s3", 2, ["new"], 0)), store)
    assert store.manifest()["number"] == 2  # nothing changed, nothing committed


def test_readers_of_an_old_manifest_still_succeed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sync.sync(raw(spark, ("a", 1, ["x"], 0), ("b", 1, ["y"], 1)), store)
    old, before = store.manifest(), state(store)
    sync.sync(raw(spark, ("a", 2, ["z", "w"], 0)), store)
    sync.sync(raw(spark, ("a", 3, ["v"], 0)), store)
    sync.upkeep(store, keep=4, age_ms=0)
    assert state(store, old) == before and state(store) != before
    versions = lambda: sum(len(store._names(f"{tmp_path}/{t}")) for t in ("sessions", "messages", "postings"))
    n, now = versions(), state(store)
    store.vacuum(keep=1, age_ms=0)
    assert versions() < n and store.numbers() == [store.manifest()["number"]] and state(store) == now


def test_only_one_of_two_writers_of_a_bucket_wins(spark, tmp_path):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    sync.sync(raw(spark, ("a", 1, ["x"], 0)), one)
    base = one.manifest()
    session = spark.createDataFrame([("s", 1, [0.5])], "session_id string, message_id bigint, embedding array<float>")
    one.append({"vectors": session}, base)
    with pytest.raises(Conflict):
        two.append({"vectors": session}, base)
    sync.append_job_phase(two, "sync", "scan", None, 1)  # another table: on top of what has come meanwhile
    late = {"job_log": spark.createDataFrame([("sync", "end", None, 2)], sync.JOB_SCHEMA)}
    assert two.append(late, base)["number"] == one.manifest()["number"] == 4
    assert two.read("job_log", sync.JOB_SCHEMA).count() == 2
    assert not one._create(f"{tmp_path}/_log/{4:020d}", "{}")  # the number is taken


def test_a_rename_that_does_not_overwrite(spark, tmp_path, monkeypatch):
    """The way of file systems without links."""
    store = Store(spark, str(tmp_path))

    class Other:
        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):  # noqa: N802
            return "other"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    plain = store._fs
    monkeypatch.setattr(store, "_fs", lambda path: (Other(plain(path)[0]), plain(path)[1]))
    assert store._create(f"{tmp_path}/x", "one") and not store._create(f"{tmp_path}/x", "two")
    assert (tmp_path / "x").read_text() == "one" and len(os.listdir(tmp_path)) <= 2


def test_buckets_split_and_logs_are_gathered(spark, tmp_path):
    store = Store(spark, str(tmp_path), bucket_bytes=4_000)
    split = store.split({"slots": [0], "local": {"0": 0}}, {"0": 4})
    assert split["slots"] == [0, 1, 2, 3] and split["local"] == {"0": 2, "1": 2, "2": 2, "3": 2}
    deeper = store.split(split, {"1": 2})
    assert deeper["slots"] == [0, 1, 2, 3, 0, 4, 2, 3] and deeper["local"] == {"0": 2, "1": 3, "2": 2, "3": 2, "4": 3}
    for i in range(18):
        sync.append_job_phase(store, "sync", "scan", None, i)
    store.compact(sync.STORED)
    assert len(store.manifest()["tables"]["job_log"]["all"]) == 1 and store.read("job_log", sync.JOB_SCHEMA).count() == 18


def test_a_common_word_reads_few_blocks(spark, tmp_path):
    rng = random.Random(4)
    store = Store(spark, str(tmp_path))
    say = lambda: " ".join("the" if rng.random() < 0.3 else f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 120)))
    sync.sync(raw(spark, *[(f"s{i}", 1, [say() for _ in range(20)], i) for i in range(600)]), store)
    sessions, messages = store.read("sessions", sync.SESSION_SCHEMA), store.read("messages", sync.MESSAGE_SCHEMA)
    got = index.blocks_read(store, sessions, "the", 20).first()
    assert got["blocks"] > 40 and 0 < got["blocks_read"] < got["blocks"] / 4
    for query in ("the", "the w3 w4"):
        assert rows(index.search_index(store, sessions, messages, query, 20)) == rows(search.fts_search(sessions, messages, query, 20))


def test_vectors_stay_with_their_messages_through_upkeep(spark, tmp_path):
    store = Store(spark, str(tmp_path), bucket_bytes=3_000)
    sync.sync(raw(spark, *[(f"s{i}", 1, [f"text {i}", "more of it"], i) for i in range(12)]), store)
    assert jobs.embed_run(store, n=5) == 12
    sync.sync(raw(spark, ("s1", 2, ["other"], 0)), store)
    sync.upkeep(store, keep=1, age_ms=0)
    vectors, messages = store.read("vectors", sync.VECTOR_SCHEMA), store.read("messages", sync.MESSAGE_SCHEMA)
    assert vectors.count() == 22 == vectors.join(messages, "message_id", "left_semi").count()
    jobs.embed_run(store)
    assert store.read("vectors", sync.VECTOR_SCHEMA).count() == 23


def test_codes_follow_the_stores_vectors(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sync.sync(raw(spark, *[(f"s{i}", 1, [f"text {i} of {i % 7} and {i % 5}", f"more {i % 11} words {i}"], i) for i in range(30)]), store)
    encoder = embed.HashedTerms(16)
    jobs.embed_run(store, encoder)
    asked = spark.createDataFrame([(1, embed.encode_query("text 3 of 3", encoder)), (2, embed.encode_query("more words", encoder))], "query_id bigint, embedding array<float>")
    assert codes.search_store(store, asked, 5).count() == 0
    codes.code_vectors(store, parts=8)
    number = lambda: (store.read("codes", codes.CODE_SCHEMA).count(), store.read("codebooks", codes.BOOKS).count())
    assert number() == (60, 1)
    sync.sync(raw(spark, ("s3", 2, ["all new"], 0)), store)
    assert number() == (58, 1)
    jobs.embed_run(store, encoder)
    codes.code_vectors(store)
    assert number() == (59, 1)
    sync.upkeep(store, keep=1, age_ms=0)
    near = lambda d: sorted((r["query_id"], r["message_id"], round(r["distance"], 6)) for r in d.collect())
    assert near(codes.search_store(store, asked, 5, 59)) == near(search.knn_batch(store.read("vectors", sync.VECTOR_SCHEMA), asked, 5))


def test_two_runs_never_embed_a_session_twice(spark, tmp_path):
    """Each takes a session from under the other's hands only when the lease is over; a lost run's work stays."""
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    sync.sync(raw(spark, *[(f"s{i}", i + 1, [f"text {i}"], i) for i in range(4)]), one)
    first = {r[0] for r in jobs.claim(one, "a", 100, n=2, lease_ms=50).collect()}
    assert len(first) == 2 and {r["status"] for r in jobs.stored_state(one, one.manifest(), 120).collect()} == {"processing", "pending"}
    assert jobs.embed_run(two, at_ms=120) == 2  # the other two
    done = {r["session_id"] for r in two.read("vectors", "session_id string, message_id bigint").collect()}
    assert len(done) == 2 and not done & first
    assert jobs.claim(two, "b", 149).count() == 0 and jobs.embed_run(two, at_ms=151) == 2  # the lease is over
    assert two.read("vectors", sync.VECTOR_SCHEMA).count() == 4 == two.read("vectors", sync.VECTOR_SCHEMA).select("message_id").distinct().count()
    base = one.manifest()
    rows = spark.createDataFrame([(next(iter(first)), "a", 10)], sync.CLAIM_SCHEMA)
    one.append({"claims": rows}, base)
    with pytest.raises(Conflict):  # both reached for the same session
        two.append({"claims": rows}, base)


def ran(spark, work):
    """Node names of each plan that a piece of work runs, as it stood in the end."""
    held = spark._jsparkSession.sharedState().statusStore()
    plans = lambda: [held.executionsList().apply(i).executionId() for i in range(held.executionsList().size())]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = set(plans())
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    graphs = [held.planGraph(n).allNodes() for n in plans() if n not in before]
    return [[g.apply(i).name() for i in range(g.size())] for g in graphs]


def test_runs_pass_no_table_through_the_driver_and_keep_plans_small(spark, tmp_path):
    """Syncs that replace sessions and a run of the encoder broadcast nothing, and no plan has hundreds of nodes (once 422)."""
    store, some = Store(spark, str(tmp_path)), [(f"s{i}", 1, ["alpha beta", "gamma delta"], i) for i in range(12)]
    sync.sync(raw(spark, *some), store)
    seen = ran(spark, lambda: sync.sync(raw(spark, *[(s, 2, ["beta", *t], n) for s, _, t, n in some[:6]]), store))
    seen += ran(spark, lambda: jobs.embed_run(store, embed.HashedTerms(16), at_ms=1))
    assert len(seen) > 10
    assert not [names for names in seen if any("Broadcast" in n for n in names)]
    assert max(map(len, seen)) < 250


def test_a_top_list_is_what_meets_the_sessions(spark, tmp_path, monkeypatch):
    """Names of found sessions are looked up by broadcasting the list, not the table of sessions (once 51,282 rows of 51,282)."""
    store = Store(spark, str(tmp_path))
    sync.sync(raw(spark, *[(f"s{i}", 1, ["alpha beta"] if i % 2 else ["gamma"], i) for i in range(6)]), store)
    monkeypatch.setattr(stored, "filled", lambda v: store)
    for words in ("alpha", '"alpha beta"'):
        found = stored.fts_indexed(None, words)
        top = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
        assert "leftHint=(strategy=broadcast)" in top
        assert [r["source_id"] for r in found.orderBy("source_id").collect()] == ["s1", "s3", "s5"]


def test_runs_read_manifests_without_jobs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sync.sync(raw(spark, ("s1", 1, ["alpha"], 0)), store)
    assert not ran(spark, lambda: store.manifest(store.numbers()[-1]))


def test_tombstones_older_than_all_rows_of_a_bucket_are_not_read(spark, tmp_path):
    store, some = Store(spark, str(tmp_path)), [(f"s{i}", 1, ["alpha beta"], i) for i in range(4)]
    sync.sync(raw(spark, *some), store)
    sync.sync(raw(spark, ("s1", 2, ["gamma"], 1)), store)
    jobs.embed_run(store, embed.HashedTerms(16), at_ms=1)
    manifest = store.manifest()
    assert not store.killing("vectors", manifest)["tables"]["tombstones"] and store.killing("messages", manifest)["tables"]["tombstones"]
    assert store.read("vectors", sync.VECTOR_SCHEMA).count() == store.read("messages", sync.MESSAGE_SCHEMA).count() == 4
    sync.sync(raw(spark, ("s2", 2, ["delta", "epsilon"], 2)), store)
    assert store.killing("vectors", store.manifest())["tables"]["tombstones"]
    assert store.read("vectors", sync.VECTOR_SCHEMA).count() == 3
