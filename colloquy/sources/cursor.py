"""Agent transcripts as JSON lines without times, and a key-value table that leads from sessions to folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import variant as V
from colloquy.functions.text import trim
from colloquy.sources.files import Folder, body, joined, json_lines, list_files, scan_files, stem_of
from colloquy.sources.rows import events, gather, side

SOURCE = "cursor"
# Keys of the table.
PROJECTS, MEMBERSHIP = "glass.localAgentProjects.v1", "glass.localAgentProjectMembership.v1"
TRANSCRIPT = r"/agent-transcripts/([^/]+)/\1\.jsonl$"


def folders(root: str) -> list[Folder]:
    return [Folder(root, "*.jsonl", recursive=True)]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Transcripts whose file is named as its folder, under agent-transcripts."""
    return list_files(spark, folders(root)).where(F.col("path").rlike(TRANSCRIPT)).withColumn("source_id", stem_of())


def directories(items: DataFrame) -> DataFrame:
    """(source_id, directory): sessions to projects to paths, from the table (key, value)."""
    values = items.select("key", V.parse("value").alias("v")).where(F.col("v").isNotNull())
    v, p = F.col("v"), F.col("p")
    projects = values.where(F.col("key") == PROJECTS).select(F.explode(V.array(v)).alias("p")).select(V.string(p, "$.id").alias("project"), V.string(p, "$.workspace.uri.fsPath").alias("directory")).dropna()
    members = values.where((F.col("key") == MEMBERSHIP) & V.is_kind(v, "OBJECT")).select(F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("source_id", "p")).select("source_id", V.string(p).alias("project"))
    return members.join(projects.dropDuplicates(["project"]), "project").select("source_id", "directory")


def content_text(items: Column, user: Column) -> Column:
    def bare(text: Column) -> Column:
        inner = F.regexp_extract(trim(text), r"(?s)^<user_query>(.*)</user_query>$", 1)
        wrapped = trim(text).rlike(r"(?s)^<user_query>.*</user_query>$")
        return trim(F.when(user & wrapped, inner).otherwise(text))

    def item(x: Column) -> Column:
        kind, text = V.string(x, "$.type"), bare(V.string(x, "$.text"))
        given = V.get(x, "$.input")
        shown = F.coalesce(V.string(given), V.text_of(given), F.lit(""))
        use = F.concat(F.lit("[tool_use:"), F.coalesce(V.string(x, "$.name"), F.lit("tool")), F.lit("] "), shown)
        return F.when((kind == "text") & (text != ""), text).when(kind == "tool_use", use)

    return F.coalesce(joined(F.transform(V.array(items), item)), F.lit(""))


def event_rows(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Event rows of files (path, modified_ms, content or lines), and of a table (source_id, directory). Files tell no time of birth here: both times are the file's."""
    v = F.col("v")
    role = V.string(v, "$.role")
    lines = json_lines(files.select("path", "modified_ms", *body(files))).withColumn("content", content_text(V.get(v, "$.message.content"), role == "user"))
    found = events(
        lines, source=F.lit(SOURCE), entry=F.col("path"), place=F.col("line_no"), role=F.when(role.isin("user", "assistant") & (F.col("content") != ""), role), content=F.col("content"),
        source_id=stem_of(), started_at=F.col("modified_ms"), dated=F.lit(True), updated_at=F.col("modified_ms"), listing=F.xxhash64("path"), bad=F.col("bad"),
    )
    return found if folders is None else found.unionByName(side(folders, SOURCE))


def parse(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Raw sessions of files (path, modified_ms, content)."""
    return gather(event_rows(files, folders))


def scan_events(spark: SparkSession, root: str, stored: DataFrame | None = None, cutoff_ms: int | None = None, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(event rows, counts of what was pruned) of the files that stored sessions and the cutoff leave; items: the key-value table."""
    files, counts = scan_files(spark, folders(root), listing(spark, root), stored, cutoff_ms)
    return event_rows(files, directories(items) if items is not None else None), counts


def scan_changed(spark: SparkSession, root: str, stored: DataFrame | None = None, cutoff_ms: int | None = None, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(raw sessions, counts of what was pruned), as scan_events."""
    found, counts = scan_events(spark, root, stored, cutoff_ms, items)
    return gather(found), counts


def scan(spark: SparkSession, root: str, items: DataFrame | None = None) -> DataFrame:
    return scan_changed(spark, root, items=items)[0]
