"""Ingest round trips with what sessions hold besides prose: tool calls and their results, side records, directories.

Every message of the given conversations is rendered with tool blocks in the shape of a source; the SQL says how each must read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import decode_directory
from colloquy.operators.sync import message_rows
from colloquy.plans.rendered import ROUND_TRIPS, _lines, _modified, _rfc
from colloquy.plans.views import Views
from colloquy.sources import claude_code, codex, copilot, cursor, gemini, kiro, opencode
from colloquy.sources.files import parent_of

def _number():
    return F.substring("session_id", 2, 20).cast("bigint")


def _said(raw: DataFrame, *more: str) -> DataFrame:
    """What each session says, and further columns."""
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return raw.select("source_id", *more, F.size("messages").alias("n_messages"), F.md5(text.cast("binary")).alias("digest"))


def _sql(content: str, name: str = "session_id", more: str = "", where: str = "true", times: int = 1) -> str:
    """The same in SQL: each message's text, and what else is selected by session."""
    return f"""SELECT {name} AS source_id, {more}(count(*) * {times})::INT AS n_messages, md5(string_agg({content}, chr(10) ORDER BY seq)) AS digest
FROM (SELECT *, substr(session_id, 2)::BIGINT AS c FROM messages) WHERE {where} GROUP BY session_id, c"""


def claude_code_tools(v: Views) -> DataFrame:
    text = F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))
    block = lambda **x: F.to_json(F.struct(*[y.alias(k) for k, y in x.items()]))
    blocks = F.array(
        F.to_json(text), block(type=F.lit("tool_use"), name=F.lit("run"), input=F.struct(F.col("seq").alias("n"))), block(type=F.lit("tool_result"), content=F.lit("out")),
        block(type=F.lit("tool_result"), content=F.array(F.struct(F.lit("text").alias("type"), F.lit("inner").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))), block(type=F.lit("thinking"), text=F.lit("no")),
    )
    line = F.struct(F.col("role").alias("type"), F.struct(F.parse_json(F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))).alias("content")).alias("message"), _rfc("timestamp").alias("timestamp"))
    files = _lines(v, line, F.concat(F.lit("/h/projects/-home-me--cfg/"), "session_id", F.lit(".jsonl"))).withColumn("directory", decode_directory(parent_of()))
    records = v.messages.select("session_id").distinct().where(_number() % 2 == 0).select(
        F.to_json(F.struct(F.col("session_id").alias("sessionId"), F.when(_number() % 4 == 0, F.concat(F.lit("/w/"), "session_id")).alias("cwd"), F.when(_number() % 3 == 0, F.lit(7)).alias("startedAt"), F.lit("cli").alias("entrypoint"))).alias("content")
    ).unionByName(v.spark.createDataFrame([("broken",)], "content string"))
    return _said(claude_code.parse(files, claude_code.sidecars(records)), "directory", "started_at", "entrypoint")


def codex_items(v: Views) -> DataFrame:
    item = lambda **x: F.to_json(F.struct(*[y.alias(k) for k, y in x.items()]))
    content = F.array(item(type=F.lit("output_text"), text=F.col("content")), item(type=F.lit("function_call"), name=F.lit("ls"), arguments=F.lit("{}")), item(type=F.lit("function_call"), arguments=F.struct(F.lit(1).alias("x"))), item(type=F.lit("function_call_output"), output=F.lit("done")))
    payload = F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.parse_json(F.concat(F.lit("["), F.array_join(content, ","), F.lit("]"))).alias("content"))
    line = F.struct(F.lit("response_item").alias("type"), _rfc("timestamp").alias("timestamp"), payload.alias("payload"))
    return _said(codex.parse(_lines(v, line, F.concat(F.lit("/h/sessions/"), "session_id", F.lit(".jsonl")))), "started_at")


def opencode_parts(v: Views) -> DataFrame:
    sessions = v.messages.groupBy("session_id").agg(F.min("timestamp").alias("time_created")).select(F.col("session_id").alias("id"), F.lit("/dir").alias("directory"), "time_created", F.lit(None).cast("bigint").alias("time_updated"))
    messages = v.messages.select(F.col("message_id").cast("string").alias("id"), "session_id", F.to_json(F.struct("role")).alias("data"), F.col("timestamp").alias("time_created"))
    data = F.array(
        F.to_json(F.struct(F.lit("text").alias("type"), F.concat(F.lit(" "), "content").alias("text"))), F.lit('{"type":"text","text":" \\n "}'), F.to_json(F.struct(F.lit("tool-invocation").alias("type"), F.lit("grep").alias("toolName"), F.struct(F.col("seq").alias("n")).alias("input"))),
        F.lit('{"type":"tool-result","result":[1,2]}'), F.lit("not-json"), F.lit('{"type":"tool-invocation"}'),
    )
    parts = v.messages.select(F.col("message_id").cast("string").alias("message_id"), F.posexplode(data).alias("n", "data")).select(F.concat(F.lit("p"), "n").alias("id"), "message_id", "data")
    return _said(opencode.parse(sessions, messages, parts), "started_at")


def kiro_turns(v: Views) -> DataFrame:
    results = F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.col("content").alias("Text")), F.struct(F.lit("more").alias("Text"))).alias("content"))).alias("tool_use_results")).alias("ToolUseResults"))
    user = F.struct(results.alias("content"), _rfc("timestamp").alias("timestamp"))
    use = F.struct(F.struct(F.lit("let me").alias("content"), F.array(F.struct(F.lit("fs").alias("name"), F.struct(F.col("seq").alias("z")).alias("args"))).alias("tool_uses")).alias("ToolUse"))
    turn = F.struct(user.alias("user"), use.alias("assistant"), F.struct(F.col("timestamp").alias("request_start_timestamp_ms")).alias("request_metadata"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(turn).alias("t")))), lambda x: x["t"])
    rows = v.messages.groupBy("session_id").agg(turns.alias("turns"), F.min("timestamp").alias("created_at"))
    value = F.concat(F.lit('{"history":['), F.array_join("turns", ","), F.lit("]}"))
    return _said(kiro.parse(rows.select(F.lit("/dir").alias("key"), F.col("session_id").alias("conversation_id"), value.alias("value"), "created_at", F.col("created_at").alias("updated_at"))), "updated_at")


def gemini_calls(v: Views) -> DataFrame:
    call = F.struct(F.lit("ls").alias("name"), F.struct(F.col("seq").alias("p")).alias("args"), F.array(F.struct(F.lit("one").alias("text")), F.struct(F.lit("two").alias("text"))).alias("result"))
    item = F.struct(F.when(F.col("role") == "user", "user").when(F.col("seq") % 5 == 1, "info").otherwise("gemini").alias("type"), F.lit("").alias("content"), F.array(call).alias("toolCalls"))
    user = F.struct(F.lit("user").alias("type"), F.lit("q").alias("content"), F.lit(None).cast(call_type()).alias("toolCalls"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("m")))), lambda x: x["m"])
    docs = v.messages.groupBy("session_id").agg(items.alias("messages"))
    doc = F.to_json(F.struct(F.concat(F.array(user), "messages").alias("messages")))
    return _said(gemini.parse(docs.select(F.concat(F.lit("/h/chats/"), "session_id", F.lit(".json")).alias("path"), doc.alias("content"))), "started_at")


def call_type() -> str:
    return "array<struct<name:string,args:struct<p:bigint>,result:array<struct<text:string>>>>"


def copilot_tools(v: Views) -> DataFrame:
    event = lambda kind, **x: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*[y.alias(k) for k, y in x.items()]).alias("data")))
    call = F.concat(F.lit("call-"), "seq")
    events = F.array(
        event("user.message", content=F.col("content")), event("tool.execution_complete", toolCallId=call, result=F.struct(F.lit("early").alias("content"))), event("tool.execution_start", toolCallId=call, toolName=F.lit("old")),
        event("tool.execution_start", toolCallId=call, toolName=F.lit("sh")), event("tool.execution_complete", toolCallId=call, result=F.struct(F.lit("short").alias("content"), F.lit(" long ").alias("detailedContent"))), event("tool.execution_complete", result=F.struct(F.lit("x").alias("content"))),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.array_join(events, "\n").alias("l")))), lambda x: x["l"])
    files = v.messages.groupBy("session_id").agg(lines.alias("lines")).select(F.concat(F.lit("/h/state/"), "session_id", F.lit("/events.jsonl")).alias("path"), _modified().alias("modified_ms"), F.array_join("lines", "\n").alias("content"))
    return _said(copilot.parse(files), "updated_at")


def cursor_directories(v: Views) -> DataFrame:
    """Sessions lead to projects, projects to folders; a third of the sessions has no project, one project no folder."""
    one = v.messages.select("session_id").distinct()
    members = one.where(_number() % 3 != 0).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("session_id", F.concat(F.lit("p"), (_number() % 4).cast("string")))))).alias("value")).select(F.lit(cursor.MEMBERSHIP).alias("key"), "value")
    projects = v.spark.createDataFrame([(cursor.PROJECTS, '[{"id":"p0","workspace":{"uri":{"fsPath":"/zero"}}},{"id":"p1","workspace":{"uri":{"fsPath":"/one"}}},{"id":"p2"},{"id":"p3","workspace":{"uri":{"fsPath":"/three"}}}]')], "key string, value string")
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("w").alias("name"), F.struct(F.col("seq").alias("a")).alias("input")))
    content = F.parse_json(F.concat(F.lit("["), F.to_json(F.struct(F.lit("text").alias("type"), F.lit("t").alias("text"))), F.lit(","), use, F.lit("]")))
    files = _lines(v, F.struct("role", F.struct(content.alias("content")).alias("message")), F.concat(F.lit("/h/agent-transcripts/"), "session_id", F.lit("/"), "session_id", F.lit(".jsonl")))
    return _said(cursor.parse(files, cursor.directories(members.unionByName(projects))), "directory")


def ingest_all(v: Views) -> DataFrame:
    """Sessions of all sources, one table: how many, and messages, of each."""
    parts = [fn(v).select("source", "n_messages") for fn, _ in ROUND_TRIPS.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("source").agg(F.count("*").alias("sessions"), F.sum("n_messages").alias("messages"))


def message_numbers(v: Views) -> DataFrame:
    """Messages of scanned sessions are numbered from 0 in their order."""
    item = F.struct("seq", F.struct("role", "content", "timestamp").alias("m"))
    raw = v.messages.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("messages")).select(F.lit("codex").alias("source"), F.col("session_id").alias("source_id"), "messages")
    rows = message_rows(raw)
    return rows.select(F.md5(F.concat("role", "content", F.col("timestamp").cast("string")).cast("binary")).alias("digest"), "seq")


TOOLS = {
    "ingest_claude_code_tools": (
        claude_code_tools,
        _sql("role || ':' || content || chr(10) || '[run] {\"n\":' || seq || '}' || chr(10) || 'out' || chr(10) || 'inner'", more="CASE WHEN c % 4 = 0 THEN '/w/' || session_id ELSE '/home/me/.cfg' END AS directory, CASE WHEN c % 2 = 1 THEN min(timestamp) WHEN c % 3 = 0 THEN 7 ELSE 0 END AS started_at, CASE WHEN c % 2 = 0 THEN 'cli' END AS entrypoint, "),
    ),
    "ingest_codex_items": (codex_items, _sql("'assistant:' || content || chr(10) || '[ls] {}' || chr(10) || 'done'", more="min(timestamp) AS started_at, ")),
    "ingest_opencode_parts": (opencode_parts, _sql("role || ': ' || content || chr(10) || role || ':[grep] {\"n\":' || seq || '}' || chr(10) || role || ':[tool] [1,2]'", more="min(timestamp) AS started_at, ", times=3)),
    "ingest_kiro_turns": (kiro_turns, _sql("'user:' || content || chr(10) || 'more' || chr(10) || 'assistant:let me' || chr(10) || '[fs] {\"z\":' || seq || '}'", more="min(timestamp) AS updated_at, ", times=2)),
    "ingest_gemini_calls": (
        gemini_calls,
        """SELECT session_id AS source_id, 0::BIGINT AS started_at, (1 + count(*) FILTER (role = 'assistant' AND seq % 5 <> 1))::INT AS n_messages,
md5('user:q' || coalesce(string_agg(chr(10) || 'assistant:[ls] {"p":' || seq || '} -> one' || chr(10) || 'two', '' ORDER BY seq) FILTER (role = 'assistant' AND seq % 5 <> 1), '')) AS digest FROM messages GROUP BY 1""",
    ),
    "ingest_copilot_tools": (
        copilot_tools,
        _sql("'user:' || regexp_replace(regexp_replace(content, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') || chr(10) || 'assistant:[tool] early' || chr(10) || 'assistant:[sh] long' || chr(10) || 'assistant:[tool] x'", more="1700000000000 + c * 1000 AS updated_at, ", times=4),
    ),
    "ingest_cursor_directories": (cursor_directories, _sql("role || ':t' || chr(10) || '[tool_use:w] {\"a\":' || seq || '}'", more="CASE WHEN c % 3 = 0 THEN NULL ELSE CASE c % 4 WHEN 0 THEN '/zero' WHEN 1 THEN '/one' WHEN 3 THEN '/three' END END AS directory, ")),
    "ingest_all": (ingest_all, "SELECT source, count(*) AS sessions, sum(n)::BIGINT AS messages FROM (SELECT session_id, count(*) FILTER (content <> '') AS n FROM messages GROUP BY 1), (SELECT unnest(['claude-code', 'opencode', 'codex', 'gemini-cli', 'kiro-cli', 'copilot-cli', 'cursor']) AS source) GROUP BY 1"),
    "message_numbers": (message_numbers, "SELECT md5(role || content || timestamp) AS digest, seq::INT AS seq FROM messages"),
}

