"""Sessions as rows, from their sources to the store, without one array of a session's messages.

A source gives one row for each message, in one pass over its logs, and rows that tell about the session: lines of the log (``told``), and
side tables by the session's id (``side``). heads() makes a row of each entry from them by plain aggregates, number() counts messages within
stretches of an entry and adds up the stretches, so that a session of any length is sorted by as many tasks as it has stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import is_noise

TOLD = "struct<source_id:string,directory:string,started_at:bigint,entrypoint:string>"
#: entry: a file or session of its source; place, tie: order in it; fallback: the id where nothing else gives one; dated: started_at stands as it
#: is; bad: text that isn't UTF-8, for which the entry is left out whole; side: about a session by its id, in no entry.
EVENTS = {
    "source": "string", "entry": "string", "place": "bigint", "tie": "string", "role": "string", "content": "string", "timestamp": "bigint", "told": TOLD, "source_id": "string", "fallback": "string",
    "directory": "string", "started_at": "bigint", "dated": "boolean", "updated_at": "bigint", "listing": "bigint", "bad": "boolean", "side": "boolean",
}
EVENT_SCHEMA = ", ".join(f"{n} {t}" for n, t in EVENTS.items())
ABSENT = {"dated": False, "bad": False, "side": False, "tie": ""}
#: Places (bytes of a log, milliseconds, or numbers) that make up a stretch.
STRETCH = 64 << 20


def told(source_id: Column | None = None, directory: Column | None = None, started_at: Column | None = None, entrypoint: Column | None = None) -> Column:
    """What a row tells about its session."""
    given = {"source_id": source_id, "directory": directory, "started_at": started_at, "entrypoint": entrypoint}
    return F.struct(*[(F.lit(None) if c is None else c).alias(n) for n, c in given.items()]).cast(TOLD)


def events(rows: DataFrame, **columns: Column) -> DataFrame:
    """Event rows with the columns given; rows that are no message, tell nothing and aren't bad are left out."""
    given = {n: columns.get(n, F.lit(ABSENT.get(n))).cast(t).alias(n) for n, t in EVENTS.items()}
    return rows.select(*given.values()).where("role IS NOT NULL OR told IS NOT NULL OR bad OR side")


def side(rows: DataFrame, source: str) -> DataFrame:
    """Event rows of a table (source_id, and any of directory, started_at, entrypoint) about sessions by their ids."""
    have = {n: F.col(n) for n in ("directory", "started_at", "entrypoint") if n in rows.columns}
    return events(rows, source=F.lit(source), source_id=F.col("source_id"), told=told(**have), side=F.lit(True))


def rows_of(raw: DataFrame) -> DataFrame:
    """Event rows of raw sessions whose source gives each as one value; those without messages have none."""
    entry = F.to_json(F.struct("source_id", "directory", "started_at", "updated_at", "listing"))
    out = raw.select("*", entry.alias("entry"), F.posexplode("messages").alias("place", "m"))
    same = {n: F.col(n) for n in ("source", "entry", "place", "source_id", "directory", "started_at", "updated_at", "listing")}
    spoken = events(out, **same, dated=F.lit(True), role=F.coalesce("m.role", F.lit("")), content=F.col("m.content"), timestamp=F.col("m.timestamp"))
    return spoken.unionByName(events(out.where("place = 0 AND entrypoint IS NOT NULL"), **same, dated=F.lit(True), told=told(entrypoint=F.col("entrypoint"))))


def _grouped(found: DataFrame, *more: Column) -> DataFrame:
    """A row for each entry with messages: what its rows say of it, further aggregates, and what side tables know of its id."""
    order = F.when(F.col("role").isNotNull(), F.struct("place", "tie"))
    same = [F.max(n).alias(n) for n in ("source_id", "fallback", "directory", "started_at", "dated", "updated_at", "listing")]
    by_entry = found.where("NOT side").groupBy("source", "entry").agg(
        *same, F.bool_or("bad").alias("bad"), F.count("role").cast("int").alias("n_messages"), F.min_by("timestamp", order).alias("first_at"), F.max_by("told", F.when(F.col("told").isNotNull(), F.col("place"))).alias("told"), *more
    )
    good = by_entry.where("n_messages > 0 AND NOT bad").withColumn("source_id", F.coalesce("source_id", "told.source_id", "fallback"))
    known = found.where("side").groupBy("source", "source_id").agg(F.max(F.struct("told.directory", "told.started_at", "told.entrypoint")).alias("known"))
    started = F.when(F.col("dated"), F.col("started_at")).otherwise(F.coalesce("known.started_at", "told.started_at", "started_at", "first_at", F.lit(0)))
    directory, entrypoint = F.coalesce("known.directory", "told.directory", "directory"), F.coalesce("known.entrypoint", "told.entrypoint")
    joined = good.join(known.hint("merge"), ["source", "source_id"], "left").withColumns({"directory": directory, "started_at": started.cast("bigint"), "entrypoint": entrypoint})
    return joined.drop("fallback", "dated", "bad", "first_at", "told", "known")


def heads(found: DataFrame) -> DataFrame:
    """Entries without their messages, but with their number and the text that gives the title: (source, source_id, directory, started_at,
    updated_at, entrypoint, listing, entry, n_messages, first_text). An entry without messages is none."""
    user, order = F.col("role") == "user", F.struct("place", "tie")
    first = [F.min_by(F.when(user, F.col("content")), F.when(which, order)) for which in (user & ~is_noise("content"), user)]
    return _grouped(found, F.coalesce(*first).alias("first_text"))


def gather(found: DataFrame) -> DataFrame:
    """Raw sessions, each with its messages as an array."""
    item = F.when(F.col("role").isNotNull(), F.struct("place", "tie", F.struct("role", "content", "timestamp").alias("m")))
    every = _grouped(found, F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("messages"))
    return every.select("source", "source_id", "directory", "started_at", "updated_at", "entrypoint", "listing", "messages")


def number(found: DataFrame, entries: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Messages of some entries (source, entry, and columns to keep), numbered from 0 in their order (seq).

    A stretch's messages are sorted in one task, a session's aren't: its stretches start at the numbers that those before them leave."""
    said = found.where("role IS NOT NULL AND NOT side").withColumn("stretch", F.floor(F.col("place") / stretch))
    at = ["source", "entry", "stretch"]
    earlier = Window.partitionBy("source", "entry").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = said.groupBy(*at).agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy(*at).orderBy("place", "tie")
    kept = said.select(*at, "place", "tie", "role", "content", "timestamp").join(starts.join(entries.hint("merge"), ["source", "entry"]).hint("merge"), at)
    return kept.withColumn("seq", (F.col("start") + F.row_number().over(within) - 1).cast("int")).drop("start", "stretch", "place", "tie")
