"""Counts, embedding state and reports over scopes of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import date_range, percentage
from colloquy.operators.filters import embeddable


def messages_per_session(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("n_messages"))


def embeddable_per_session(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count_if(embeddable()).alias("n_embeddable"))


def pending_messages(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embeddable messages without a vector."""
    return messages.where(embeddable()).join(vectors.select("message_id").hint("merge"), "message_id", "left_anti")


def embedded_count(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Messages with a vector, counted."""
    return messages.join(vectors.select("message_id"), "message_id", "left_semi").agg(F.count("*").alias("embedded"))


def average_text_length(texts: DataFrame, text: str) -> DataFrame:
    """Mean length in characters, whole number."""
    return texts.agg(F.coalesce(F.floor(F.avg(F.length(text))), F.lit(0)).cast("bigint").alias("average_chars"))


def embedding_state(sessions: DataFrame, messages: DataFrame, vectors: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """(session_id, units_total, units_done, status, last_error) of each session, from what is stored: done, processing, pending, or failed where a failure is on record."""
    marked = messages.where(embeddable()).join(vectors.select("message_id", F.lit(1).alias("has")).dropDuplicates(["message_id"]).hint("merge"), "message_id", "left")
    units = marked.groupBy("session_id").agg(F.count("*").alias("units_total"), F.count("has").alias("units_done"))
    joined = sessions.select(F.col("id").alias("session_id")).join(units.hint("merge"), "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counted = joined.select("session_id", zero("units_total"), zero("units_done"))
    failed = failures.groupBy("session_id").agg(F.max_by("error", "at").alias("last_error")) if failures is not None else None
    counted = counted.join(failed.hint("merge"), "session_id", "left") if failed is not None else counted.withColumn("last_error", F.lit(None).cast("string"))
    status = F.when(F.col("units_done") >= F.col("units_total"), "done").when(F.col("last_error").isNotNull(), "failed").when(F.col("units_done") > 0, "processing").otherwise("pending")
    return counted.withColumn("status", status)


def embedding_progress(sessions: DataFrame, state: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row: total, done, processing, failed, pending in scope; zeros for an empty scope."""
    scope = (sessions.where(condition) if condition is not None else sessions).select(F.col("id").alias("session_id"))
    return state.join(scope, "session_id", "left_semi").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "processing", "failed", "pending")])


def scope_totals(sessions: DataFrame, messages: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row: sessions and messages in scope, in one pass over counts per session."""
    scope = (sessions.where(condition) if condition is not None else sessions).select(F.col("id").alias("session_id"))
    counted = scope.join(messages_per_session(messages), "session_id", "left")
    return counted.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n_messages"), F.lit(0)).alias("messages"))


def newest_processing_title(sessions: DataFrame, state: DataFrame) -> DataFrame:
    at = F.coalesce("updated_at", "started_at")
    busy = sessions.join(state.where(F.col("status") == "processing").select(F.col("session_id").alias("id")), "id", "left_semi")
    return busy.agg(F.max_by("title", F.struct(at, "id")).alias("processing_title"))


def scope_metrics(sessions: DataFrame, messages: DataFrame, state: DataFrame, condition: Column | None = None) -> DataFrame:
    """One row of totals, progress and the title in work."""
    one = scope_totals(sessions, messages, condition).withColumn("k", F.lit(1))
    for other in (embedding_progress(sessions, state, condition), newest_processing_title(sessions.where(condition) if condition is not None else sessions, state)):
        one = one.join(F.broadcast(other.withColumn("k", F.lit(1))), "k")
    return one.drop("k")


def work_list(sessions: DataFrame, state: DataFrame, n: int = 1) -> DataFrame:
    """The next n pending sessions, last touched first: (session_id, title, units_total). Failed and processing ones are not taken up again."""
    touched = F.coalesce("updated_at", "started_at")
    pending = state.where(F.col("status") == "pending").join(sessions.select(F.col("id").alias("session_id"), "title", touched.alias("touched")).hint("merge"), "session_id")
    return pending.orderBy(F.col("touched").desc(), "session_id").limit(n).select("session_id", "title", "units_total")


def claim(sessions: DataFrame, state: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """(the next n pending sessions, the state after they are taken): a taken session is processing and has no error any more."""
    taken = work_list(sessions, state, n)
    marked = state.join(F.broadcast(taken.select("session_id", F.lit(True).alias("taken"))), "session_id", "left")  # n rows
    after = marked.withColumn("status", F.when(F.col("taken"), "processing").otherwise(F.col("status"))).withColumn("last_error", F.when(F.col("taken").isNull(), F.col("last_error")))
    return taken, after.drop("taken")


def is_embedded(state: DataFrame) -> bool:
    """Whether any session is done or in work, so that a query's vector can find something."""
    return not state.where(F.col("status").isin("done", "processing")).isEmpty()


def largest_pending_session(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """The session with most embeddable messages still to do; with none to do, the one with most embeddable messages."""
    all_units = messages.where(embeddable()).join(vectors.select("message_id", F.lit(0).alias("has")).dropDuplicates(["message_id"]), "message_id", "left")
    counted = all_units.groupBy("session_id").agg(F.count_if(F.col("has").isNull()).alias("pending"), F.count("*").alias("units"))
    return counted.orderBy(F.col("pending").desc(), F.col("units").desc(), "session_id").limit(1)


def pending_exists(state: DataFrame) -> DataFrame:
    return state.agg((F.count_if(F.col("status") == "pending") > 0).alias("pending_exists"))


def source_summary(sessions: DataFrame) -> DataFrame:
    """Per source: sessions, messages, oldest and newest start; and a row of totals under the name total."""
    return sessions.rollup("source").agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"), F.min("started_at").alias("oldest"), F.max("started_at").alias("newest"), F.grouping("source").alias("g")).select(
        F.when(F.col("g") == 1, "total").otherwise(F.col("source")).alias("source"), "sessions", "messages", "oldest", "newest"
    )


def source_report(sessions: DataFrame, state: DataFrame, enabled: list[str]) -> DataFrame:
    """The summary with dates, whether a source is on, and how much of it is embedded (pending includes processing)."""
    by = state.join(sessions.select(F.col("id").alias("session_id"), "source"), "session_id").rollup("source").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status").isin("pending", "processing")).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"), F.grouping("source").alias("g")
    ).select(F.when(F.col("g") == 1, "total").otherwise(F.col("source")).alias("source"), "total", "done", "pending", "failed")
    return source_summary(sessions).join(F.broadcast(by), "source", "left").select(
        "source", "sessions", "messages", date_range("oldest", "newest").alias("dates"), (F.col("source").isin(enabled) | (F.col("source") == "total")).alias("enabled"), "done", "pending", "failed", percentage("done", "total").alias("done_pct")
    )
