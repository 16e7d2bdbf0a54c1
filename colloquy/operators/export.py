"""Transcripts and listings as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import export_name, flatten


def _head(title: str = "title") -> Column:
    """The lines above a transcript's messages; ``n_messages`` counts those that follow."""
    date = F.coalesce(F.date_format(F.timestamp_millis("started_at"), "yyyy-MM-dd HH:mm"), F.lit(""))
    lines = [("Session", F.col(title)), ("Source", F.col("source")), ("Directory", F.col("directory")), ("Date", date), ("Messages", F.coalesce("n_messages", F.lit(0)))]
    return F.concat(F.concat_ws("", *[F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\n")) for name, c in lines]), F.lit("\n---\n\n"))


def _block() -> Column:
    return F.concat(F.lit("## "), F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"))


def _named(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    return sessions.join(F.broadcast(labels), "source", "left").withColumn("file", export_name(F.coalesce("label", "source"), "title"))


def transcripts(sessions: DataFrame, messages: DataFrame, labels: DataFrame) -> DataFrame:
    """(session_id, source, file, text) of every session: header lines, a rule, and a block for each message in order."""
    bodies = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", _block().alias("b")))), lambda x: x["b"]), "").alias("body"))
    joined = _named(sessions, labels).join(bodies, sessions["id"] == bodies["session_id"], "left")
    return joined.select(F.col("id").alias("session_id"), "source", "file", F.concat(_head(), F.coalesce("body", F.lit(""))).alias("text"))


def write_transcripts(sessions: DataFrame, messages: DataFrame, labels: DataFrame, path: str) -> None:
    """A folder for each session, <path>/source=<source>/file=<name>/session=<id>, with its transcript as one text file.

    Messages stay rows: they are dealt out by session, sorted and written one after another, so a session of any length needs no array."""
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))
    named = _named(sessions, labels)
    heads = named.join(counts, named["id"] == counts["session_id"], "left").select(F.col("id").alias("session"), "source", "file", F.lit(-1).alias("seq"), _head().alias("text"))
    blocks = messages.join(named.select("id", "source", "file"), F.col("id") == F.col("session_id")).select(F.col("id").alias("session"), "source", "file", "seq", _block().alias("text"))
    # by a hash of the session, not the session itself, by which both sides are dealt out already, each into tasks of its own
    rows = heads.unionByName(blocks).repartition(F.xxhash64("session")).sortWithinPartitions("source", "file", "session", "seq")
    # each row ends in a line break already; the writer adds one more, so that one is taken off
    rows.select("source", "file", "session", F.expr("left(text, length(text) - 1)").alias("text")).write.mode("overwrite").partitionBy("source", "file", "session").text(path)


def listing(sessions: DataFrame) -> DataFrame:
    """(source, source_id, time, title) of all sessions, newest first, titles on one line."""
    time = F.date_format(F.timestamp_millis("started_at"), "yyyy-MM-dd'T'HH:mm:ss")
    return sessions.orderBy(F.col("started_at").desc(), "id").select("source", "source_id", time.alias("time"), flatten("title").alias("title"))


def write_listing(found: DataFrame, path: str) -> None:
    found.write.mode("overwrite").csv(path, sep="\t")
