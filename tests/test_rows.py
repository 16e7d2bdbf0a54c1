"""Sessions that come as rows give what arrays of their messages give."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import NOISE
from colloquy.operators import sync
from colloquy.operators.store import Store
from colloquy.sources import claude_code, codex, copilot, every, kiro, rows, session_files

UUID = "0199aaaa-bbbb-cccc-dddd-eeeeffff0000"


def put(root, name, *said):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\n".join(x if isinstance(x, bytes) else json.dumps(x).encode() for x in said))


def tables(store):
    return [sorted(map(str, store.read(t, s).collect())) for t, s in (("sessions", sync.SESSION_SCHEMA), ("messages", sync.MESSAGE_SCHEMA))]


def spoken(text, role="user", at=None):
    kind = "user_message" if role == "user" else "agent_message"
    return {"type": "event_msg", "timestamp": at, "payload": {"type": kind, "message": text}}


@pytest.fixture
def roots(spark, tmp_path):
    record = {"type": "session_meta", "payload": {"id": "inner", "cwd": "/w", "timestamp": "2024-01-02T00:00:00Z"}}
    put(tmp_path, f"codex/sessions/rollout-x-{UUID}.jsonl", record, spoken("q", at="2024-01-01T00:00:00Z"), b"no json", spoken(""), spoken("a", "assistant"))
    put(tmp_path, f"codex/sessions/2024/rollout-y-{UUID}.jsonl", spoken("same id"), spoken("other file"))
    put(tmp_path, f"codex/archived_sessions/rollout-x-{UUID[:-1]}1.jsonl", spoken("fine"), spoken("then"), b"\xff\xfe")
    put(tmp_path, "cc/projects/-home-me/one.jsonl", {"type": "user", "message": {"content": f"{NOISE[0]} x"}}, {"type": "user", "message": {"content": "real question"}, "timestamp": "2024-01-01T00:00:00Z"})
    put(tmp_path, "cc/projects/-home-me/none.jsonl", {"type": "user"}, b"")
    put(tmp_path, "cc/sessions/1.json", {"sessionId": "one", "cwd": "/side", "entrypoint": "cli"})
    put(tmp_path, "cc/sessions/2.json", {"sessionId": "nobody", "cwd": "/x"})
    put(tmp_path, "cpl/d/events.jsonl", {"type": "session.start", "data": {"sessionId": "c", "context": {"cwd": "/c"}}}, {"type": "user.message", "data": {"content": "q"}}, {"type": "tool.execution_start", "data": {"toolCallId": "1", "toolName": "sh"}}, {"type": "tool.execution_complete", "data": {"toolCallId": "1", "result": {"content": "out"}}})
    put(tmp_path, "cur/p/agent-transcripts/u/u.jsonl", {"role": "user", "message": {"content": [{"type": "text", "text": "hi"}]}})
    put(tmp_path, "gem/x/chats/a.json", {"sessionId": "g", "startTime": "2024-01-01T00:00:00Z", "messages": [{"type": "user", "content": "q"}, {"type": "user", "content": "r"}]})
    turns = {"history": [{"user": {"content": {"Prompt": {"prompt": "q"}}}, "assistant": {"Response": {"content": "done"}}}]}
    table = spark.createDataFrame([("/k", "k", json.dumps(turns), 1, 2), ("/k", "k", json.dumps(turns), 1, 3), ("/k", "nil", json.dumps(turns), None, 2)], "key string, conversation_id string, value string, created_at bigint, updated_at bigint")
    s = spark.createDataFrame([("s1", "/d", 10, 20)], "id string, directory string, time_created bigint, time_updated bigint")
    m = spark.createDataFrame([("m1", "s1", '{"role":"user"}', 1), ("m2", "s1", '{"role":"assistant"}', 1)], "id string, session_id string, data string, time_created bigint")
    p = spark.createDataFrame([("p2", "m1", '{"type":"text","text":"b"}'), ("p1", "m2", '{"type":"text","text":"a"}')], "id string, message_id string, data string")
    return {"codex": f"{tmp_path}/codex", "claude-code": f"{tmp_path}/cc", "copilot-cli": f"{tmp_path}/cpl", "cursor": f"{tmp_path}/cur", "gemini-cli": f"{tmp_path}/gem", "kiro-cli": table, "opencode": (s, m, p)}


def test_all_sources_give_the_same_tables(spark, tmp_path, roots):
    by_rows, by_arrays = (Store(spark, str(tmp_path / n)) for n in ("rows", "arrays"))
    found, _ = every.scan_events(spark, roots)
    one = sync.sync_rows(found, by_rows)
    two = sync.sync(rows.gather(found), by_arrays)
    assert sorted(one.collect()) == sorted(two.collect()) and tables(by_rows) == tables(by_arrays)
    sessions = {(r["source"], r["source_id"]): r for r in by_rows.read("sessions", sync.SESSION_SCHEMA).collect()}
    assert ("codex", UUID[:-1] + "1") not in sessions  # not UTF-8 throughout
    assert len(sessions) == 8 and ("claude-code", "nobody") not in sessions
    one = sessions["claude-code", "one"]
    assert (one["title"], one["directory"], one["started_at"], one["entrypoint"], one["message_count"]) == ("real question", "/side", 0, "cli", 2)
    assert (sessions["copilot-cli", "c"]["directory"], sessions["copilot-cli", "c"]["started_at"]) == ("/c", 0)
    assert sessions["kiro-cli", "k"]["updated_at"] is not None and sessions["kiro-cli", "nil"]["started_at"] is None
    texts = [r["content"] for r in by_rows.read("messages", sync.MESSAGE_SCHEMA).where(F.col("session_id") == sessions["opencode", "s1"]["id"]).orderBy("seq").collect()]
    assert texts == ["a", "b"]  # equal times go by the part's id
    again = every.sync_sources(spark, roots, by_rows)
    assert {r["action"] for r in again.collect()} <= {"unchanged", "updated"}


def entries(spark, given):
    """Event rows of (entry, source_id, updated_at, listing, texts), places far apart, in no order."""
    flat = [(e, i, u, n, p * 7, t) for e, i, u, n, texts in given for p, t in enumerate(texts)]
    random.Random(1).shuffle(flat)
    found = spark.createDataFrame(flat, "entry string, source_id string, updated_at bigint, listing bigint, place bigint, text string")
    same = {n: F.col(n) for n in ("entry", "source_id", "updated_at", "listing", "place")}
    return rows.events(found, **same, source=F.lit("codex"), started_at=F.lit(1000), dated=F.lit(True), role=F.lit("user"), content=F.col("text"))


@pytest.mark.parametrize("options", [{}, {"force": True, "cutoff_ms": 5000}])
def test_random_runs(spark, tmp_path, options):
    rng = random.Random(str(options))
    by_rows, by_arrays = (Store(spark, str(tmp_path / n)) for n in ("rows", "arrays"))
    for run in range(2):
        given = [(f"{run}-{n}", f"s{rng.randrange(5)}", rng.choice([None, 1, 2, 9000]), rng.randrange(3), ["t"] * rng.randrange(1, 4) + [f"x{rng.random()}"]) for n in range(9)]
        found = entries(spark, given)
        one, two = sync.sync_rows(found, by_rows, **options), sync.sync(rows.gather(found), by_arrays, **options)
        assert sorted(one.collect()) == sorted(two.collect())
        left, right = tables(by_rows), tables(by_arrays)
        assert left == right


def test_a_long_session_is_numbered_by_stretches(spark):
    n = 5000
    long = spark.range(n).select(F.lit("long").alias("entry"), (F.col("id") * 10).alias("place"), F.concat(F.lit("t"), "id").alias("text"))
    other = spark.createDataFrame([("short", 3, "a"), ("short", 900, "b"), ("not asked", 1, "c")], "entry string, place bigint, text string")
    found = rows.events(long.unionByName(other), source=F.lit("s"), entry=F.col("entry"), place=F.col("place"), role=F.lit("user"), content=F.col("text"))
    asked = spark.createDataFrame([("s", "long", 1), ("s", "short", 2)], "source string, entry string, tag int")
    out = rows.number(found, asked, stretch=100)
    got = {(r["tag"], r["seq"]): r["content"] for r in out.collect()}
    assert got == {(1, i): f"t{i}" for i in range(n)} | {(2, 0): "a", (2, 1): "b"}
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "stretch" in plan


def test_a_log_in_many_ranges(spark, tmp_path):
    """Read by ranges and numbered by stretches far smaller than the log, it is what it is when read at once."""
    texts = [f"message {i} é" for i in range(700)]
    put(tmp_path, f"rollout-x-{UUID}.jsonl", *[spoken(t) for t in texts])
    listing = session_files.list_sessions(spark, str(tmp_path), "*.jsonl")
    found = codex.event_rows(session_files.read_lines(listing, range_bytes=1 << 12, marked=True))
    head = rows.heads(found).collect()
    assert len(head) == 1 and (head[0]["source_id"], head[0]["n_messages"], head[0]["first_text"]) == (UUID, 700, texts[0])
    out = rows.number(found, rows.heads(found).select("source", "entry"), stretch=1 << 12)
    assert [r["content"] for r in out.orderBy("seq").collect()] == texts
    put(tmp_path, f"rollout-x-{UUID}.jsonl", *[spoken(t) for t in texts], b"\xff")
    bad = codex.event_rows(session_files.read_lines(session_files.list_sessions(spark, str(tmp_path), "*.jsonl"), range_bytes=1 << 12, marked=True))
    assert rows.heads(bad).count() == 0 and rows.gather(bad).count() == 0


def test_nothing_gives_nothing(spark, tmp_path):
    none = spark.createDataFrame([], rows.EVENT_SCHEMA)
    assert rows.heads(none).count() == 0 and rows.gather(none).count() == 0
    assert sync.sync_rows(none, Store(spark, str(tmp_path / "s"))).count() == 0
    aside = rows.side(spark.createDataFrame([("a", "/d")], "source_id string, directory string"), "codex")
    assert rows.heads(aside).count() == 0


@pytest.mark.parametrize("module", [claude_code, copilot])
def test_side_rows_and_lines_are_read_once(spark, tmp_path, module):
    """The plan of an entry's head scans its lines once: side tables are told apart before anything is read."""
    files = spark.createDataFrame([("/p/x.jsonl", 1, "{}", "x", "/d")], "path string, modified_ms bigint, content string, source_id string, directory string")
    files.write.parquet(str(tmp_path / "f"))
    plan = rows.heads(module.event_rows(spark.read.parquet(str(tmp_path / "f"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_kiro_rows(spark):
    turns = {"history": [{"user": {"content": {"Prompt": {"prompt": "q"}}}, "assistant": {"Response": {"content": "done"}}}]}
    table = spark.createDataFrame([("/k", "k", json.dumps(turns), 1, 2)], "key string, conversation_id string, value string, created_at bigint, updated_at bigint")
    raw = kiro.parse(table)
    assert rows.gather(rows.rows_of(raw)).collect() == raw.select(*rows.gather(rows.rows_of(raw)).columns).collect()


def test_sessions_of_many_stretches_are_stored_whole(spark, tmp_path):
    """A session of 70 messages: their stretched places go beyond 32 bits."""
    from colloquy.operators import sync
    from colloquy.plans import stored
    from colloquy.plans.views import Views

    turns = [(1, n, "user" if n % 2 == 0 else "assistant", f"turn {n}") for n in range(70)]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    store = stored.filled_by_rows(Views(spark, str(tmp_path)))
    got = sorted((r["seq"], r["content"]) for r in store.read("messages", sync.MESSAGE_SCHEMA).collect())
    assert got == [(n, f"turn {n}") for n in range(70)]
