"""Chats as one JSON document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import variant as V
from colloquy.functions.text import rfc3339_ms, trim
from colloquy.sources.files import Folder, argument_text, assemble, joined, list_files, named, parent_of, read_all, stem_of

SOURCE = "gemini-cli"


def folders(root: str) -> list[Folder]:
    return [Folder(root, "*.json", recursive=True)]


def listing(spark: SparkSession, root: str) -> DataFrame:
    return list_files(spark, folders(root)).where(parent_of() == "chats").withColumn("source_id", stem_of())


def tool_text(calls: Column) -> Column:
    def call(x: Column) -> Column:
        result = joined(F.transform(V.array(x, "$.result"), lambda r: V.string(r, "$.text")))
        return F.concat(named(x, "$.name", argument_text(x, "$.args")), F.when(F.coalesce(result, F.lit("")) != "", F.concat(F.lit(" -> "), result)).otherwise(F.lit("")))

    return F.coalesce(joined(F.transform(V.array(calls), call)), F.lit(""))


def parse(files: DataFrame) -> DataFrame:
    """Raw sessions of files (path, content)."""
    docs = files.select("path", V.parse("content").alias("doc")).where(F.col("doc").isNotNull())
    doc, m = F.col("doc"), F.col("m")
    rows = docs.select(
        "path", V.string(doc, "$.sessionId").alias("id"), rfc3339_ms(V.string(doc, "$.startTime")).alias("started"), rfc3339_ms(V.string(doc, "$.lastUpdated")).alias("updated"), F.posexplode(V.array(doc, "$.messages")).alias("n", "m")
    )
    kind = V.string(m, "$.type")
    role = F.when(kind == "user", "user").when(kind == "gemini", "assistant")
    prose = trim(F.coalesce(V.string(m, "$.content"), F.lit("")))
    tools = F.when(kind == "gemini", tool_text(V.get(m, "$.toolCalls"))).otherwise(F.lit(""))
    ready = rows.select("path", "id", "started", "updated", "n", role.alias("role"), F.concat_ws("\n", F.when(prose != "", prose), F.when(tools != "", tools)).alias("content"), rfc3339_ms(V.string(m, "$.timestamp")).alias("timestamp"))
    sessions = assemble(ready.where(F.col("role").isNotNull() & (F.col("content") != "")), ["path", "id", "started", "updated"], ["n"])
    return sessions.select(
        F.lit(SOURCE).alias("source"), F.coalesce("id", stem_of()).alias("source_id"), F.lit(None).cast("string").alias("directory"), F.coalesce("started", F.lit(0)).cast("bigint").alias("started_at"), F.col("updated").alias("updated_at"), F.lit(None).cast("string").alias("entrypoint"), F.xxhash64("path").alias("listing"), "messages"
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    return parse(read_all(spark, folders(root)).where(parent_of() == "chats"))
