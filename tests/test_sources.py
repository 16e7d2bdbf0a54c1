import json
import os
import time

import pytest

from colloquy.operators import sync
from colloquy.sources import claude_code, codex, copilot, cursor, gemini, kiro, opencode, session_files
from colloquy.streaming import jobs

UUID = "0199aaaa-bbbb-cccc-dddd-eeeeffff0000"


def lines(*rows):
    return "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows)


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def said(raw):
    return {r["source_id"]: [(m["role"], m["content"], m["timestamp"]) for m in r["messages"]] for r in raw.collect()}


def test_claude_code(spark, tmp_path):
    content = [{"type": "text", "text": "see"}, {"type": "tool_use", "name": "run", "input": {"b": 1, "a": [2]}}, {"type": "tool_use", "input": None}, {"type": "tool_result", "content": "out"}, {"type": "tool_result", "content": [{"type": "text", "text": "in"}, {"type": "image"}]}, {"type": "text", "text": 5}]
    put(tmp_path, "projects/-home-me--cfg/one.jsonl", lines("not json", {"type": "user", "message": {"content": "hello"}, "timestamp": "2024-01-01T00:00:00Z"}, {"type": "system", "message": {"content": "no"}}, {"type": "assistant", "message": {"content": content}}, {"type": "user", "message": {"content": ""}}, ""))
    put(tmp_path, "projects/-p/empty.jsonl", lines({"type": "user"}))
    put(tmp_path, "projects/-p/bad.jsonl", b"\xff\xfe\xfd\xfc")
    put(tmp_path, "transcripts/deep/er/two.jsonl", lines({"type": "user", "message": {"content": "hi"}}))
    put(tmp_path, "sessions/1.json", json.dumps({"sessionId": "two", "cwd": "/w", "entrypoint": "cli"}))
    put(tmp_path, "sessions/2.json", "broken")
    found = claude_code.scan(spark, str(tmp_path))
    rows = {r["source_id"]: r for r in found.collect()}
    assert said(found) == {"one": [("user", "hello", 1704067200000), ("assistant", 'see\n[run] {"a":[2],"b":1}\n[tool] null\nout\nin', None)], "two": [("user", "hi", None)]}
    assert rows["one"]["directory"] == "/home/me/.cfg" and rows["one"]["started_at"] == 1704067200000
    assert (rows["two"]["directory"], rows["two"]["started_at"], rows["two"]["entrypoint"]) == ("/w", 0, "cli")


def test_codex(spark, tmp_path):
    put(tmp_path, f"sessions/2024/01/rollout-2024-{UUID}.jsonl", lines({"type": "session_meta", "payload": {"id": "first", "cwd": "/a"}}, {"type": "session_meta", "payload": {"id": "id-1", "timestamp": "2024-01-01T00:00:00Z"}}, {"type": "event_msg", "timestamp": "2024-01-01T00:00:01Z", "payload": {"type": "user_message", "message": "q"}}, {"type": "event_msg", "payload": {"type": "token_count"}}, {"type": "response_item", "timestamp": "2024-01-01T00:00:02Z", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "a"}, {"type": "function_call", "name": "f", "arguments": "{}"}, {"type": "function_call", "arguments": {"x": 1}}, {"type": "function_call_output", "output": "o"}]}}))
    put(tmp_path, "sessions/notes.jsonl", lines({"type": "event_msg", "payload": {"type": "user_message", "message": "q"}}))
    put(tmp_path, f"archived_sessions/r-{UUID[:-1]}1.jsonl", b"\xff\xfe\xfd\xfc")
    found = codex.scan(spark, str(tmp_path))
    assert said(found) == {UUID: [("user", "q", 1704067201000), ("assistant", "a\n[f] {}\no", 1704067202000)]}
    row = found.first()
    modified = int((tmp_path / f"sessions/2024/01/rollout-2024-{UUID}.jsonl").stat().st_mtime_ns // 10**6)
    assert (row["directory"], row["started_at"], row["updated_at"]) == (None, 1704067200000, modified)


def test_opencode(spark):
    sessions = spark.createDataFrame([("s1", "/d", 10, 20), ("s2", None, 10, 20), ("s3", "/d", 10, None)], "id string, directory string, time_created bigint, time_updated bigint")
    messages = spark.createDataFrame([("m1", "s1", '{"role":"user"}', 1), ("m2", "s1", '{"role":"assistant"}', 2), ("m3", "s2", '{"role":"user"}', 1), ("m4", "s3", '{"role":"system"}', 1)], "id string, session_id string, data string, time_created bigint")
    parts = [("p1", "m1", '{"type":"text","text":" q "}'), ("p2", "m1", '{"type":"text","text":" \\n "}'), ("p3", "m2", '{"type":"tool-invocation","toolName":"t","input":{"k":null}}'), ("p4", "m2", '{"type":"tool-result","result":null}'), ("p5", "m2", "not-json"), ("p6", "m2", '{"type":"tool-invocation"}'), ("p7", "m3", '{"type":"text","text":"x"}'), ("p8", "m4", '{"type":"text","text":"x"}')]
    p = spark.createDataFrame(parts, "id string, message_id string, data string")
    assert said(opencode.parse(sessions, messages, p)) == {"s1": [("user", " q ", 1), ("assistant", '[t] {"k":null}', 2), ("assistant", "[tool] null", 2)]}
    stored = spark.createDataFrame([("s1", 20, 3)], "source_id string, updated_at bigint, message_count int")
    assert opencode.parse(sessions, messages, p, stored=stored).count() == 0
    assert opencode.parse(sessions, messages, p, stored=stored.selectExpr("source_id", "updated_at", "2 as message_count")).count() == 1
    assert opencode.parse(sessions, messages, p, cutoff_ms=21).count() == 0


def test_gemini(spark, tmp_path):
    doc = {"sessionId": "g", "startTime": "2024-01-01T00:00:00Z", "messages": [{"type": "user", "content": " q "}, {"type": "info", "content": "no"}, {"type": "gemini", "content": "", "toolCalls": [{"name": "ls", "args": {"p": "."}, "result": [{"text": "a"}, {"x": 1}, {"text": "b"}]}, {"args": {}}]}, {"type": "gemini", "content": " "}]}
    put(tmp_path, "x/chats/a.json", json.dumps(doc))
    put(tmp_path, "x/chats/b.json", json.dumps({"messages": [{"type": "user", "content": "only"}]}))
    put(tmp_path, "x/other/c.json", json.dumps(doc))
    put(tmp_path, "x/chats/d.json", "{}")
    assert said(gemini.scan(spark, str(tmp_path))) == {"g": [("user", "q", None), ("assistant", '[ls] {"p":"."} -> a\nb\n[tool] {}', None)], "b": [("user", "only", None)]}


def test_kiro(spark):
    history = [
        {"user": {"content": {"Prompt": {"prompt": "q"}}, "timestamp": "2024-01-01T00:00:00Z"}, "assistant": {"ToolUse": {"content": "let me", "tool_uses": [{"name": "fs", "args": {"z": 1}}]}}, "request_metadata": {"request_start_timestamp_ms": 7}},
        {"user": {"content": {"ToolUseResults": {"tool_use_results": [{"content": [{"Text": "t"}, {"Json": {"b": 1, "a": 2}}]}, {}]}}}, "assistant": {"Response": {"content": "done"}}},
        {"user": {"content": {}}, "assistant": {"Response": {"content": ""}}},
    ]
    rows = spark.createDataFrame([("/c", "k", json.dumps({"history": history}), 1, 2), ("/c", "none", "{}", 1, 2), ("/c", "bad", "x", 1, 2)], "key string, conversation_id string, value string, created_at bigint, updated_at bigint")
    found = kiro.parse(rows)
    assert said(found) == {"k": [("user", "q", 1704067200000), ("assistant", 'let me\n[fs] {"z":1}', 7), ("user", 't\n{"a":2,"b":1}', None), ("assistant", "done", None)]}
    assert found.first()["directory"] == "/c"


def test_copilot(spark, tmp_path):
    events = lines({"type": "session.start", "data": {"sessionId": "c", "startTime": "2024-01-01T00:00:00Z", "context": {"cwd": "/w"}}}, {"type": "user.message", "data": {"content": " q "}}, {"type": "assistant.message", "data": {"content": "a", "toolRequests": [{"name": "sh", "arguments": {"c": "ls"}}]}}, {"type": "tool.execution_complete", "data": {"toolCallId": "1", "result": {"content": "early"}}}, {"type": "tool.execution_start", "data": {"toolCallId": "1", "toolName": "sh"}}, {"type": "tool.execution_complete", "data": {"toolCallId": "1", "result": {"content": "short", "detailedContent": " long "}}}, {"type": "tool.execution_complete", "data": {"result": {"content": "x"}}}, {"type": "tool.execution_complete", "data": {"toolCallId": "1"}})
    put(tmp_path, "dir1/events.jsonl", events)
    put(tmp_path, "dir2/events.jsonl", lines({"type": "user.message", "data": {"content": "q"}}))
    put(tmp_path, "dir3/other.txt", "x")
    found = copilot.scan(spark, str(tmp_path))
    assert {k: [m[1] for m in v] for k, v in said(found).items()} == {"c": ["q", 'a\n[sh] {"c":"ls"}', "[tool] early", "[sh] long", "[tool] x"], "dir2": ["q"]}
    assert {r["updated_at"] for r in found.collect()} == {int(f.stat().st_mtime_ns // 10**6) for f in tmp_path.glob("*/events.jsonl")}
    files = spark.createDataFrame([("/a/dir9/events.jsonl", lines(*["{}"] * 16, {"type": "session.start", "data": {"sessionId": "late"}})), ("/a/dir8/events.jsonl", events), ("/a/dir7/events.jsonl", lines({"type": "session.start", "data": {}}, {"type": "session.start", "data": {"sessionId": "second"}}))], "path string, content string")
    assert dict(map(tuple, copilot.peek_id(files).collect())) == {"/a/dir9/events.jsonl": "dir9", "/a/dir8/events.jsonl": "c", "/a/dir7/events.jsonl": "dir7"}


def test_cursor(spark, tmp_path):
    content = [{"type": "text", "text": " <user_query>\nq\n</user_query> "}, {"type": "tool_use", "name": "w", "input": "raw"}, {"type": "tool_use", "input": {"b": 1, "a": 2}}, {"type": "text", "text": " "}]
    put(tmp_path, "p/agent-transcripts/u1/u1.jsonl", lines("not json", {"role": "user", "message": {"content": content}}, {"role": "assistant", "message": {"content": content[:1]}}, {"role": "tool", "message": {"content": content}}))
    put(tmp_path, "p/agent-transcripts/u2/other.jsonl", lines({"role": "user", "message": {"content": content}}))
    items = spark.createDataFrame([(cursor.PROJECTS, json.dumps([{"id": "p1", "workspace": {"uri": {"fsPath": "/w"}}}, {"id": "p2"}])), (cursor.MEMBERSHIP, json.dumps({"u1": "p1", "u2": "p2", "u3": 5}))], "key string, value string")
    found = cursor.scan(spark, str(tmp_path), items)
    assert said(found) == {"u1": [("user", 'q\n[tool_use:w] raw\n[tool_use:tool] {"a":2,"b":1}', None), ("assistant", "<user_query>\nq\n</user_query>", None)]}
    assert found.first()["directory"] == "/w"


@pytest.mark.parametrize("parse", [codex.parse, codex.event_rows])
def test_stream_merges_new_and_rewritten_files(spark, tmp_path, parse):
    """After restarts from the checkpoint the store holds what a batch run would; what has not changed is not listed again."""
    root, store = tmp_path / "in", sync.Store(spark, str(tmp_path / "store"))
    run = lambda: jobs.sync_stream(spark, str(root), "*.jsonl", parse, store, str(tmp_path / "ck"), lag_ms=0).awaitTermination(120)
    titles = lambda: {r["title"] for r in store.read("sessions", sync.SESSION_SCHEMA).collect()}
    said = lambda *texts: lines(*[{"type": "event_msg", "payload": {"type": "user_message", "message": t}} for t in texts])
    put(root, "r0.jsonl", said("m0"))
    run()
    assert titles() == {"m0"}
    time.sleep(0.05)
    put(root, "r1.jsonl", said("m1"))
    put(root, "r0.jsonl", said("m0 again", "and more"))
    run()
    assert titles() == {"m0 again", "m1"} and store.read("messages", sync.MESSAGE_SCHEMA).count() == 3
    number = store.manifest()["number"]
    run()
    assert store.manifest()["number"] == number


def test_listing_reads_no_content(spark, tmp_path):
    put(tmp_path, "projects/-p/a.jsonl", "x")
    (tmp_path / "transcripts").mkdir()
    found = claude_code.listing(spark, str(tmp_path))
    assert found.first()["size"] == 1 and "content:binary" not in found._jdf.queryExecution().executedPlan().toString()


def test_session_files_are_listed_in_tasks(spark, tmp_path):
    for n in range(20):
        put(tmp_path, f"d{n}/events.jsonl", "\n".join(f"line {i} é" for i in range(50)))
    put(tmp_path, "d3/deep/events.jsonl", "deep")
    put(tmp_path, "d3/other.txt", "no")
    os.utime(tmp_path / "d5" / "events.jsonl", (1000, 1000))
    found = session_files.list_sessions(spark, f"{tmp_path}/*", "events.jsonl", peek=3)
    rows = found.collect()
    assert len(rows) == 20 and {r["head"] for r in rows} == {"line 0 é\nline 1 é\nline 2 é"} and all(r["path"].startswith("file:/") for r in rows)
    old = found.where("modified_ms <= 1000000")
    assert [r["modified_ms"] for r in old.collect()] == [1_000_000]
    assert session_files.list_sessions(spark, str(tmp_path), "events.jsonl", recursive=True).count() == 21
    assert session_files.list_sessions(spark, f"{tmp_path}/nowhere", "*").count() == 0
    reader = session_files.Reader({"path": str(tmp_path)})
    left = list(reader.pushFilters([session_files.GreaterThan(("modified_ms",), 5), session_files.EqualTo(("head",), "x")]))
    assert reader.filters == [("GreaterThan", "modified_ms", 5)] and len(left) == 1


@pytest.mark.parametrize("text", ["a\nbb\n\nccc", "a\n", "", "\n\n", "x" * 50 + "\nend", "é☃\n" * 9])
def test_ranges_of_lines_make_up_a_file(spark, tmp_path, text, monkeypatch):
    monkeypatch.setattr(session_files, "CHUNK", 4)
    put(tmp_path, "f", text)
    data, want, at = text.encode(), [], 0
    for line in data.split(b"\n"):
        want.append((at, line))
        at += len(line) + 1
    want = want[:-1] if not want[-1][1] else want
    system, inside, _ = session_files.file_system(str(tmp_path / "f"))
    for step in (1, 2, 3, 7, 100):
        assert [x for start in range(0, max(1, len(data)), step) for x in session_files.lines_of(system, inside, start, start + step)] == want


def test_lines_are_read_in_ranges(spark, tmp_path):
    put(tmp_path, "a/x.jsonl", "".join(f"line {i}\n" for i in range(1000)))
    (tmp_path / "a" / "bad.jsonl").write_bytes(b"good\n" * 100 + b"\xff\xfe\n")
    (tmp_path / "a" / "none.jsonl").write_bytes(b"")
    listed = session_files.list_sessions(spark, f"{tmp_path}/a", "*.jsonl")
    got = session_files.read_lines(listed, 64).orderBy("line_no").collect()
    assert [r["line"] for r in got] == [f"line {i}" for i in range(1000)]


def message(text):
    return {"type": "event_msg", "payload": {"type": "user_message", "message": text}}


def rollout(n):
    return f"sessions/rollout-x-{UUID[:-2]}{n:02d}.jsonl"


def roots(path):
    return {"codex": f"{path}/codex", "claude-code": f"{path}/cc", "gemini-cli": f"{path}/gem", "copilot-cli": f"{path}/cpl", "cursor": (f"{path}/cur", None)}


def test_absent_folders_hold_no_sessions(spark, tmp_path):
    from colloquy.sources.every import scan_all

    raw, counts = scan_all(spark, roots(tmp_path))
    assert raw.count() == 0 and counts.count() == 0
    put(tmp_path, f"codex/{rollout(0)}", lines(message("q")))  # no archive beside it
    assert scan_all(spark, roots(tmp_path))[0].count() == 1
    assert scan_all(spark, roots(tmp_path), enabled=["cursor"])[0].count() == 0


def test_sync_opens_changed_files_alone(spark, tmp_path):
    from colloquy.sources.every import sync_sources

    store = sync.Store(spark, str(tmp_path / "store"))
    count = lambda d: {r["action"]: (r["sessions"], r["messages"]) for r in d.collect()}
    run = lambda **k: count(sync_sources(spark, roots(tmp_path), store, **k))
    for n in range(3):
        put(tmp_path, f"codex/{rollout(n)}", lines(message(f"m{n}")))
    put(tmp_path, "cc/projects/-p/[odd] name {1}.jsonl", lines({"type": "user", "message": {"content": "hello"}}))
    put(tmp_path, "cpl/d/events.jsonl", lines({"type": "user.message", "data": {"content": "q"}}))
    assert run() == {"new": (5, 5)}
    assert run() == {"unchanged": (5, 0)}
    # a file of which nothing changed by its time is not opened, even if its content could not be read
    path = tmp_path / "codex" / rollout(0)
    at = path.stat().st_mtime_ns
    path.write_bytes(json.dumps(message("not to be seen")).encode())
    os.utime(path, ns=(at, at))
    put(tmp_path, f"codex/{rollout(1)}", lines(message("m1"), message("more")))
    put(tmp_path, "cc/projects/-p/[odd] name {1}.jsonl", lines({"type": "user", "message": {"content": "again"}}))
    assert run() == {"updated": (2, 3), "unchanged": (3, 0)}
    said_now = {r["content"] for r in store.read("messages", sync.MESSAGE_SCHEMA).collect()}
    assert said_now == {"m0", "m1", "more", "m2", "again", "q"}
    late = int(time.time() * 1000) + 10**7
    assert run(cutoff_ms=late) == {"filtered": (5, 0)}


@pytest.mark.parametrize("name, ok", [(f"/a/rollout-x-{UUID}.jsonl", True), (f"/a/{UUID}.jsonl", False), ("/a/notes.jsonl", False)])
def test_codex_names(spark, name, ok):
    got = spark.createDataFrame([(name,)], "path string").select(codex.file_id().alias("i")).first()["i"]
    assert got == (UUID if ok else None)
