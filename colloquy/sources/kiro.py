"""A key-value table of conversations (key, conversation_id, value, created_at, updated_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import variant as V
from colloquy.functions.text import rfc3339_ms
from colloquy.sources.files import argument_text, assemble, joined, named

SOURCE = "kiro-cli"


def user_text(user: Column) -> Column:
    def piece(x: Column) -> Column:
        return F.coalesce(V.string(x, "$.Text"), V.text_of(V.get(x, "$.Json")))

    results = F.flatten(F.transform(V.array(user, "$.content.ToolUseResults.tool_use_results"), lambda r: F.coalesce(F.transform(V.array(r, "$.content"), piece), F.array().cast("array<string>"))))
    return F.coalesce(V.string(user, "$.content.Prompt.prompt"), joined(results), F.lit(""))


def assistant_text(assistant: Column) -> Column:
    prose = V.string(assistant, "$.ToolUse.content")
    uses = F.transform(V.array(assistant, "$.ToolUse.tool_uses"), lambda x: named(x, "$.name", argument_text(x, "$.args")))
    tools = F.concat(F.array(F.when(prose != "", prose)), F.coalesce(uses, F.array().cast("array<string>")))
    return F.coalesce(V.string(assistant, "$.Response.content"), joined(tools), F.lit(""))


def parse(rows: DataFrame) -> DataFrame:
    """Raw sessions; a turn gives up to two messages, the assistant's at the request's start."""
    docs = rows.select("key", "conversation_id", "created_at", "updated_at", V.parse("value").alias("doc")).where(F.col("doc").isNotNull())
    turns = docs.select("key", "conversation_id", "created_at", "updated_at", F.posexplode(V.array(F.col("doc"), "$.history")).alias("n", "turn"))
    turn = F.col("turn")
    both = F.array(
        F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), user_text(V.get(turn, "$.user")).alias("content"), rfc3339_ms(V.string(turn, "$.user.timestamp")).alias("timestamp")),
        F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), assistant_text(V.get(turn, "$.assistant")).alias("content"), V.integer(turn, "$.request_metadata.request_start_timestamp_ms").alias("timestamp")),
    )
    messages = turns.select("key", "conversation_id", "created_at", "updated_at", "n", F.explode(both).alias("x")).select("key", "conversation_id", "created_at", "updated_at", "n", "x.*").where(F.col("content") != "")
    sessions = assemble(messages, ["key", "conversation_id", "created_at", "updated_at"], ["n", "side"])
    return sessions.select(
        F.lit(SOURCE).alias("source"), F.col("conversation_id").alias("source_id"), F.col("key").alias("directory"), F.col("created_at").alias("started_at"), "updated_at", F.lit(None).cast("string").alias("entrypoint"), (-F.col("updated_at")).alias("listing"), "messages"
    )
