"""Ingest round trips: the given conversations are rendered in the shape of each source, ingested, and compared with what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.plans.views import Views
from colloquy.sources import claude_code, codex, copilot, cursor, gemini, kiro, opencode

MODIFIED = 1_700_000_000_000


def _modified() -> Column:
    """A time of each session's file."""
    return F.lit(MODIFIED) + F.substring("session_id", 2, 20).cast("bigint") * 1000


def _uuid() -> Column:
    """An id for a rollout's name, other than the session's own."""
    h = F.md5(F.col("session_id").cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _rfc(c: str) -> Column:
    return F.date_format(F.timestamp_millis(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _lines(v: Views, line: Column, path: Column, first: Column | None = None) -> DataFrame:
    """Files (path, modified_ms, content, source_id, directory) of a JSON line for each message, after a line that is none and, if given, a first record."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(line, {"ignoreNullFields": "true"}).alias("l")))), lambda x: x["l"])
    grouped = v.messages.groupBy("session_id").agg(ordered.alias("lines"))
    return grouped.select(path.alias("path"), _modified().alias("modified_ms"), F.array_join(F.concat(F.array(F.lit("not json"), *([F.to_json(first)] if first is not None else [])), "lines"), "\n").alias("content"), F.col("session_id").alias("source_id"), F.lit("/dir").alias("directory"))


def _digest(raw: DataFrame) -> DataFrame:
    """What a session says, as one digest of roles and contents in order."""
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return raw.select("source", "source_id", "directory", "started_at", "updated_at", F.size("messages").alias("n_messages"), F.md5(text.cast("binary")).alias("digest"))


def _claude(v: Views) -> DataFrame:
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))
    line = F.struct(F.col("role").alias("type"), F.struct(block.alias("content")).alias("message"), _rfc("timestamp").alias("timestamp"))
    return _digest(claude_code.parse(_lines(v, line, F.concat(F.lit("/h/projects/-dir/"), "session_id", F.lit(".jsonl")))))


def _codex(v: Views) -> DataFrame:
    kind = F.when(F.col("role") == "user", "user_message").otherwise("agent_message")
    line = F.struct(F.lit("event_msg").alias("type"), _rfc("timestamp").alias("timestamp"), F.struct(kind.alias("type"), F.col("content").alias("message")).alias("payload"))
    meta = F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("inner-"), "session_id").alias("id"), F.lit("/dir").alias("cwd")).alias("payload"))
    return _digest(codex.parse(_lines(v, line, F.concat(F.lit("/h/sessions/rollout-2024-"), _uuid(), F.lit(".jsonl")), meta)))


def _copilot(v: Views) -> DataFrame:
    line = F.struct(F.concat("role", F.lit(".message")).alias("type"), _rfc("timestamp").alias("timestamp"), F.struct("content").alias("data"))
    start = F.struct(F.lit("session.start").alias("type"), F.struct(F.concat(F.lit("inner-"), "session_id").alias("sessionId"), F.struct(F.lit("/dir").alias("cwd")).alias("context")).alias("data"))
    return _digest(copilot.parse(_lines(v, line, F.concat(F.lit("/h/state/"), "session_id", F.lit("/events.jsonl")), start)))


def _cursor(v: Views) -> DataFrame:
    shown = F.when(F.col("role") == "user", F.concat(F.lit("<user_query>\n"), "content", F.lit("\n</user_query>"))).otherwise(F.col("content"))
    line = F.struct("role", F.struct(F.array(F.struct(F.lit("text").alias("type"), shown.alias("text"))).alias("content")).alias("message"))
    return _digest(cursor.parse(_lines(v, line, F.concat(F.lit("/h/agent-transcripts/"), "session_id", F.lit("/"), "session_id", F.lit(".jsonl")))))


def _gemini(v: Views) -> DataFrame:
    item = F.struct(F.when(F.col("role") == "user", "user").otherwise("gemini").alias("type"), "content", _rfc("timestamp").alias("timestamp"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", item.alias("m")))), lambda x: x["m"])
    docs = v.messages.groupBy("session_id").agg(items.alias("messages"), F.min("timestamp").alias("at"), F.max("timestamp").alias("last"))
    doc = F.to_json(F.struct(F.col("session_id").alias("sessionId"), _rfc("at").alias("startTime"), _rfc("last").alias("lastUpdated"), "messages"))
    return _digest(gemini.parse(docs.select(F.concat(F.lit("/h/chats/"), "session_id", F.lit(".json")).alias("path"), doc.alias("content"))))


def _kiro(v: Views) -> DataFrame:
    user = F.when(F.col("role") == "user", F.struct(F.struct(F.struct(F.col("content").alias("prompt")).alias("Prompt")).alias("content"), _rfc("timestamp").alias("timestamp")))
    reply = F.when(F.col("role") == "assistant", F.struct(F.struct("content").alias("Response")))
    turn = F.struct(user.alias("user"), reply.alias("assistant"), F.struct(F.col("timestamp").alias("request_start_timestamp_ms")).alias("request_metadata"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(turn).alias("t")))), lambda x: x["t"])
    rows = v.messages.groupBy("session_id").agg(turns.alias("turns"), F.min("timestamp").alias("created_at"))
    value = F.concat(F.lit('{"history":['), F.array_join("turns", ","), F.lit("]}"))
    return _digest(kiro.parse(rows.select(F.lit("/dir").alias("key"), F.col("session_id").alias("conversation_id"), value.alias("value"), "created_at", F.lit(MODIFIED).alias("updated_at"))))


def _opencode(v: Views) -> DataFrame:
    sessions = v.messages.groupBy("session_id").agg(F.min("timestamp").alias("time_created")).select(F.col("session_id").alias("id"), F.lit("/dir").alias("directory"), "time_created", F.lit(MODIFIED).alias("time_updated"))
    messages = v.messages.select(F.col("message_id").cast("string").alias("id"), "session_id", F.to_json(F.struct("role")).alias("data"), F.col("timestamp").alias("time_created"))
    parts = v.messages.select(F.concat(F.lit("p"), "message_id").alias("id"), F.col("message_id").cast("string").alias("message_id"), F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("data"))
    return _digest(opencode.parse(sessions, messages, parts))


_FILE_TIME = f"{MODIFIED} + substr(session_id, 2)::BIGINT * 1000"
_UUID = "substr(md5(session_id), 1, 8) || '-' || substr(md5(session_id), 9, 4) || '-' || substr(md5(session_id), 13, 4) || '-' || substr(md5(session_id), 17, 4) || '-' || substr(md5(session_id), 21, 12)"


def _sql(source: str, directory: str | None = None, started: str = "min(timestamp)", trimmed: bool = False, updated: str = f"{MODIFIED}", name: str = "session_id") -> str:
    text = r"regexp_replace(regexp_replace(content, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')" if trimmed else "content"
    folder = f"'{directory}'" if directory else "NULL::VARCHAR"
    return rf"""SELECT '{source}' AS source, {name} AS source_id, {folder} AS directory, {started} AS started_at, {updated} AS updated_at, count(*)::INT AS n_messages, md5(string_agg(role || ':' || t.t, chr(10) ORDER BY seq)) AS digest
FROM (SELECT *, {text} AS t FROM messages) t WHERE t.t <> '' GROUP BY session_id"""


ROUND_TRIPS = {
    "ingest_claude_code": (_claude, _sql("claude-code", "/dir", updated=_FILE_TIME)),
    "ingest_codex": (_codex, _sql("codex", "/dir", updated=_FILE_TIME, name=_UUID)),
    "ingest_opencode": (_opencode, _sql("opencode", "/dir")),
    "ingest_gemini": (_gemini, _sql("gemini-cli", trimmed=True, updated="(SELECT max(timestamp) FROM messages m WHERE m.session_id = t.session_id)", started="(SELECT min(timestamp) FROM messages m WHERE m.session_id = t.session_id)")),
    "ingest_kiro": (_kiro, _sql("kiro-cli", "/dir")),
    "ingest_copilot": (_copilot, _sql("copilot-cli", "/dir", trimmed=True, updated=_FILE_TIME, name="'inner-' || session_id")),
    "ingest_cursor": (_cursor, _sql("cursor", started=_FILE_TIME, trimmed=True, updated=_FILE_TIME)),
}
