import os

from colloquy.operators import export, filters

SESSION = "id string, source string, source_id string, title string, directory string, started_at bigint, updated_at bigint, message_count int, entrypoint string"
MESSAGE = "message_id bigint, session_id string, role string, content string, timestamp bigint, seq int"
WANT = {
    "a": "Session: One\nSource: codex\nDirectory: /d\nDate: 1970-01-01 00:01\nMessages: 2\n\n---\n\n## User\n\nhi\n\nthere\n\n## Assistant\n\nyes \n\n",
    "b": "Session: One\nSource: codex\nDate: 1970-01-02 00:00\nMessages: 0\n\n---\n\n",
}


def tables(spark):
    sessions = spark.createDataFrame([("a", "codex", "1", "One", "/d", 60_000, None, 9, None), ("b", "codex", "2", "One", None, 86_400_000, None, 9, None)], SESSION)
    messages = spark.createDataFrame([(2, "a", "assistant", "yes ", None, 1), (1, "a", "user", "hi\n\nthere", None, 0)], MESSAGE)
    return sessions, messages, filters.source_table(spark)


def test_transcripts_are_laid_out(spark):
    """Source ids, not labels; messages that are there counted; each block ends in an empty line."""
    assert {r["session_id"]: r["text"] for r in export.transcripts(*tables(spark)).collect()} == WANT


def test_a_file_for_each_session(spark, tmp_path):
    export.write_transcripts(*tables(spark), str(tmp_path / "out"))
    for session, text in WANT.items():
        folder = tmp_path / "out" / "source=codex" / "file=CDX-One.txt" / f"session={session}"
        (file,) = [f for f in os.listdir(folder) if f.startswith("part-")]
        assert (folder / file).read_text() == text
