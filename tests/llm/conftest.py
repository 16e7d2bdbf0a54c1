import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, uid int, h int, spans string, score double"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows, parts=2):
        data = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "k", 1, 2, "s", 0.5) for i, t in rows]
        return spark.createDataFrame(data, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd():
    """Null and empty texts, blanks, repeated rows, a null id, a very long text and a word without end."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (None, "x y z"), (5, "word " * 60_000), (6, "x" * 50_000), (7, "é☃ 中文 İ ẞ"), (8, "a b c")]
