"""Event logs, a folder for each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import variant as V
from colloquy.functions.text import rfc3339_ms, trim
from colloquy.sources.files import Folder, argument_text, body, joined, json_lines, list_files, named, parent_of, prune, pruned
from colloquy.sources.rows import events, gather, told
from colloquy.sources.session_files import read_lines

SOURCE = "copilot-cli"
#: Lines in which the id of a session is looked for before its log is read.
PEEK = 16


def peek_id(files: DataFrame) -> DataFrame:
    """(path, source_id): the id of the first session start, if it stands within the first lines and has one, else the folder's name."""
    return files.select("path", _peeked().alias("source_id"))


def _peeked(head: str = "content") -> Column:
    """The id by which a file's session is known, from its first lines alone."""
    values = F.transform(F.slice(F.split(head, "\n", PEEK + 1), 1, PEEK), lambda line: V.parse(trim(line)))
    starts = F.filter(values, lambda v: V.string(v, "$.type") == "session.start")
    return F.coalesce(V.string(F.get(starts, 0), "$.data.sessionId"), parent_of())


def folders(root: str) -> list[Folder]:
    return [Folder(f"{root}/*", "events.jsonl")]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_ms, size, head) of logs; their ids stand in their first lines, which are read and no others."""
    return list_files(spark, folders(root), PEEK)


def request_text(requests: Column) -> Column:
    return F.coalesce(joined(F.transform(V.array(requests), lambda x: named(x, "$.name", argument_text(x, "$.arguments")))), F.lit(""))


def event_rows(files: DataFrame) -> DataFrame:
    """Event rows of files (path, modified_ms, and content or lines with source_id), known by their first lines' id, updated when the file was. A finished tool has the name of the latest start before it with its id, else "tool"."""
    name = "source_id" if "line" in files.columns else _peeked().alias("source_id")
    lines = json_lines(files.select("path", "modified_ms", name, *body(files)))
    v = F.col("v")
    kind = V.string(v, "$.type")
    text = lambda c: trim(F.coalesce(c, F.lit("")))
    result = text(F.coalesce(V.string(v, "$.data.result.detailedContent"), V.string(v, "$.data.result.content")))
    call = F.coalesce(V.string(v, "$.data.toolCallId"), F.concat(F.lit("\n"), "line_no"))  # without id: alone
    about = told(directory=V.string(v, "$.data.context.cwd"), started_at=rfc3339_ms(V.string(v, "$.data.startTime")))
    rows = lines.where(V.present(v, "$.data") | F.col("bad")).select(
        "path", "modified_ms", "source_id", "line_no", "bad", kind.alias("kind"), rfc3339_ms(V.string(v, "$.timestamp")).alias("timestamp"), call.alias("call"), F.when(kind == "tool.execution_start", V.string(v, "$.data.toolName")).alias("started"),
        text(V.string(v, "$.data.content")).alias("prose"), F.when(kind == "assistant.message", request_text(V.get(v, "$.data.toolRequests"))).alias("requests"), result.alias("result"), F.when(kind == "session.start", about).alias("about"),
    )
    before = Window.partitionBy("path", "call").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tool = F.coalesce(F.last("started", ignorenulls=True).over(before), F.lit("tool"))
    spoken = F.col("kind").isin("user.message", "assistant.message")
    finished = (F.col("kind") == "tool.execution_complete") & (F.col("result") != "")
    prose = F.concat_ws("\n", F.when(F.col("prose") != "", F.col("prose")), F.when(F.col("requests") != "", F.col("requests")))
    content = F.when(spoken, prose).when(finished, F.concat(F.lit("["), "tool", F.lit("] "), "result"))
    said = F.when(F.col("content") != "", F.when(F.col("kind") == "user.message", "user").otherwise("assistant"))
    return events(
        rows.withColumn("tool", tool).withColumn("content", content), source=F.lit(SOURCE), entry=F.col("path"), place=F.col("line_no"), role=said, content=F.col("content"), timestamp=F.col("timestamp"), told=F.col("about"),
        source_id=F.col("source_id"), updated_at=F.col("modified_ms"), listing=F.xxhash64("path"), bad=F.col("bad"),
    )


def parse(files: DataFrame) -> DataFrame:
    """Raw sessions of files (path, modified_ms, and content or lines with source_id)."""
    return gather(event_rows(files))


def scan_events(spark: SparkSession, root: str, stored: DataFrame | None = None, cutoff_ms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(event rows, counts of what was pruned). Files older than the cutoff are not opened, and of the others those of unchanged sessions no
    further than their first lines."""
    found = listing(spark, root)
    young = found if cutoff_ms is None or stored is None else found.where(F.col("modified_ms") >= cutoff_ms)
    known = young.withColumn("source_id", F.coalesce(_peeked("head"), parent_of())).drop("head")
    if stored is None:
        return event_rows(read_lines(known, marked=True)), None
    marked = prune(known, stored)
    # times alone, so nothing is peeked into
    times = list_files(spark, folders(root))
    old = times.where(F.lit(False) if cutoff_ms is None else F.col("modified_ms") < cutoff_ms).agg(F.count("*").alias("sessions")).where("sessions > 0").select(F.lit("filtered").alias("action"), "sessions")
    return event_rows(read_lines(marked.where("scan = 'parse'").drop("scan"), marked=True)), pruned(marked).unionByName(old)


def scan_changed(spark: SparkSession, root: str, stored: DataFrame | None = None, cutoff_ms: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(raw sessions, counts of what was pruned), as scan_events."""
    found, counts = scan_events(spark, root, stored, cutoff_ms)
    return gather(found), counts


def scan(spark: SparkSession, root: str) -> DataFrame:
    return scan_changed(spark, root)[0]
