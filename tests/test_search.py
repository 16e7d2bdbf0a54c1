import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import codes, embed, evaluate, filters, search

CORPUS = [
    ("s1", "claude-code", "src-1", "how do I debug tokio async streams with backpressure"),
    ("s2", "codex", "src-2", "ratatui constraint layout tricks for nested panels"),
    ("s3", "opencode", "src-3", "postgres migration rollback strategies with zero downtime"),
    ("s4", "codex", "src-4", "a segfault in the parser when snake case names meet Café tables"),
    ("s5", "codex", "src-5", "foo-bar and tokio tokio again, the parser of iterators"),
]


@pytest.fixture(scope="module")
def store(spark):
    sessions = spark.createDataFrame([(i, s, sid, text, None, 1000 * n, None, 1, None) for n, (i, s, sid, text) in enumerate(CORPUS)], "id string, source string, source_id string, title string, directory string, started_at bigint, updated_at bigint, message_count int, entrypoint string")
    messages = spark.createDataFrame([(n, i, "user", text, None, 0) for n, (i, _, _, text) in enumerate(CORPUS)], "message_id bigint, session_id string, role string, content string, timestamp bigint, seq int")
    vectors = spark.createDataFrame([(n, [float(n == k) for k in range(5)]) for n in range(4)], "message_id bigint, embedding array<float>")
    return sessions.cache(), messages.cache(), vectors.cache()


@pytest.mark.parametrize("query", ["tokio", "tokio OR tokio", "parser tokio", "cafe", "zzzznonexistent", "the with"])
def test_rank_equals_fts5(spark, store, query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(content, tokenize='unicode61')")
    db.executemany("insert into f(rowid, content) values (?, ?)", [(n + 1, c[3]) for n, c in enumerate(CORPUS)])
    words = [w for w in X.rewrite_query(query) if w]
    match = " OR ".join('"' + " ".join(w) + '"' for w in words)
    want = {r - 1: v for r, v in db.execute("select rowid, bm25(f) from f where f match ?", (match,))}
    got = search.score_messages(search.build_postings(store[1]), search.build_lengths(store[1]), query)
    found = {r["message_id"]: r["rank"] for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(found[k], want[k], abs_tol=1e-9) for k in want)


def test_queries_are_rewritten(store):
    assert X.rewrite_query("bug OR 1=1 --") == [["bug"], ["or"], ["11"]]
    assert X.rewrite_query("AND OR NOT") == [["and"], ["or"], ["not"]]
    assert X.rewrite_query("foo-bar snake_case _") == [["foobar"], ["snake", "case"], []]
    sessions, messages, _ = store
    assert search.fts_search(sessions, messages, "foo-bar").count() == 0
    assert [r["session_id"] for r in search.fts_search(sessions, messages, "snake_case").collect()] == ["s4"]
    for blank in ("", "   ", "--", "_"):
        assert search.fts_search(sessions, messages, blank).count() == 0


def test_source_filter_comes_before_the_limit(store):
    sessions, messages, _ = store
    found = search.fts_search(sessions, messages, "tokio", 1, condition=filters.session_filter(["claude-code"]))
    assert [r["session_id"] for r in found.collect()] == ["s1"]


def test_vector_filter_comes_after_the_cut(store):
    sessions, messages, vectors = store
    only = filters.session_filter(["codex"])
    assert search.knn_search(sessions, messages, vectors, [1.0, 0, 0, 0, 0], 60, condition=only).count() == 2
    near = search.knn_messages(vectors, [1.0, 0, 0, 0, 0], 1).collect()
    assert near[0]["message_id"] == 0 and near[0]["distance"] == 0
    found = search.knn_search(sessions, messages, vectors, [1.0, 0, 0, 0, 0], 60, condition=only, prefilter=True)
    assert {r["session_id"] for r in found.collect()} == {"s2", "s4"}


def test_fused_list_holds_both_tops(store):
    sessions, messages, vectors = store
    rows = search.hybrid_search(sessions, messages, vectors, "tokio", [0, 0, 1.0, 0, 0]).collect()
    label = {r["session_id"]: r["match"] for r in rows}
    assert {"s5", "s3"} <= label.keys() and label["s3"] == "VEC" and label["s5"] == "FTS" and label["s1"] == "HYB"
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))
    alone = search.hybrid_search(sessions, messages, vectors, "tokio").collect()
    assert {r["match"] for r in alone} == {"FTS"}


def test_index_on_disk_gives_the_same(spark, store, tmp_path):
    sessions, messages, _ = store
    search.write_index(messages, str(tmp_path), 2)
    postings, lengths = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("postings", "lengths"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(search.fts_search(sessions, messages, "tokio the", postings=postings, lengths=lengths)) == rows(search.fts_search(sessions, messages, "tokio the"))


def test_only_the_querys_postings_are_read(spark, store, tmp_path):
    search.write_index(store[1], str(tmp_path), 2)
    plan = search.word_frequencies(spark.read.parquet(f"{tmp_path}/postings"), [["tokio"]])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,tokio)" in plan


def test_evaluation(spark, store):
    sessions, messages, _ = store
    rows = [
        (1, "tokio async", [("claude-code", "src-1")], None),
        (2, "postgres", [("codex", "missing")], None),
        (3, "parser", [("codex", "src-4"), ("codex", "src-5")], None),
        (4, "ratatui", [("codex", "src-2"), ("codex", "gone")], None),
        (5, "", [("codex", "src-2")], None),
    ]
    entries = spark.createDataFrame(rows, "query_id bigint, query string, expected array<struct<source:string,source_id:string>>, notes string")
    lengths = search.build_lengths(messages)
    results = evaluate.batch_results(entries, sessions, search.build_postings(messages), lengths, search.corpus_stats(lengths))
    details = evaluate.query_details(entries, results)
    got = {r["query_id"]: (r["best_rank"], r["hits"]) for r in details.collect()}
    assert got == {1: (1, 1), 2: (None, 0), 3: (1, 2), 4: (1, 1), 5: (None, 0)}
    one = evaluate.metrics(details).first()
    assert (one["total"], one["hit_at_5"], one["hit_at_10"], one["hit_at_5_pct"], one["mrr"]) == (5, 3, 3, 60.0, 0.6)
    assert {r["query_id"] for r in evaluate.failures(details).collect()} == {2, 5}
    assert evaluate.metrics(details.where(F.lit(False))).first()["mrr"] == 0.0


def test_many_queries_find_what_single_ones_find(spark, store):
    """Phrases and accents too: one rewriting for both."""
    sessions, messages, _ = store
    asked = ["snake_case", "Café", "tokio_tokio", "tokio tokio", "parser_of", "parser_of the_parser parser", "_", "cafe_tables zero_downtime", "a_segfault in_the"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string")
    lengths = search.build_lengths(messages)
    found = evaluate.batch_fts(queries, search.build_postings(messages), lengths, search.corpus_stats(lengths), 60).collect()
    for n, query in enumerate(asked):
        want = {r["session_id"]: r["rank"] for r in search.fts_search(sessions, messages, query).collect()}
        assert {r["session_id"]: r["rank"] for r in found if r["query_id"] == n} == want
    assert {r["session_id"] for r in found if r["query_id"] == 0} == {"s4"} == {r["session_id"] for r in found if r["query_id"] == 1}


def test_evaluation_set_is_read(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"query": "a", "expected": [{"source": "codex", "source_id": "x"}]}]')
    assert evaluate.read_entries(spark, str(tmp_path / "e.json")).first()["expected"][0]["source_id"] == "x"
    with pytest.raises(Exception):
        evaluate.read_entries(spark, str(tmp_path / "none.json"))


def test_many_query_vectors(spark, monkeypatch):
    """More queries than a block or a task holds, and ties decided by id."""
    import numpy as np

    for name, n in (("BLOCK", 8), ("CHUNK", 16), ("HELD", 20), ("MOST_QUERIES", 20)):
        monkeypatch.setattr(search, name, n, raising=False)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)).astype(np.float32)
    x[40:80] = x[40]
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "message_id bigint, embedding array<float>")
    found = search.knn_batch(vectors, vectors.withColumnRenamed("message_id", "query_id"), 5).collect()
    x = x.astype(float)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(q, int(m)) for q in range(90) for m in np.lexsort((np.arange(90), far[q]))[:5]}
    assert {(r["query_id"], r["message_id"]) for r in found} == want and len(found) == 450
    assert all(math.isclose(r["distance"], far[r["query_id"], r["message_id"]], abs_tol=1e-9) for r in found)


ODD_VECTORS = [(90, None), (91, [1.0, 0.0]), (92, [None, 0.0, 0.0, 0.0, 0.0]), (93, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (94, [])]


def test_vectors_that_are_not_whole_take_no_place(spark, store):
    _, _, vectors = store
    mixed = vectors.unionByName(spark.createDataFrame(ODD_VECTORS, vectors.schema))
    query = [1.0, 0.0, 0.0, 0.0, 0.0]
    assert [r["message_id"] for r in search.knn_messages(mixed, query, 3).collect()] == [0, 1, 2]
    asked = spark.createDataFrame([(1, query), (2, None)], "query_id bigint, embedding array<float>")
    for found in (search.knn_batch(mixed, asked, 9), codes.approximate_neighbours(mixed, asked, 9)):
        assert sorted((r["query_id"], r["message_id"]) for r in found.collect()) == [(1, i) for i in range(4)]
    assert codes.approximate_neighbours(mixed.where("message_id >= 90 and message_id <> 91 and message_id < 93"), asked, 9).count() == 0


def test_codes(spark):
    """Coded distances are those to what codes stand for; re-ranking all is the exact search; few re-ranked find most."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 10)).astype(np.float32)
    x[600:] = x[:300]  # ties
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "message_id bigint, embedding array<float>")
    books = codes.fit(vectors, parts=4)
    cell, code, bias = books.encode(x.astype(float))
    near = np.concatenate([e[code[:, m]] for m, e in enumerate(books.entries)], axis=1) + books.centres[cell]
    q = x[:7].astype(float)
    assert np.allclose(books.far(books.tables(q), cell, code, bias), ((q[:, None] - near[None]) ** 2).sum(2)) and code.shape == (900, 4)
    asked = vectors.where("message_id % 20 = 0").withColumnRenamed("message_id", "query_id")
    rows = lambda d: sorted((r["query_id"], r["message_id"], round(r["distance"], 9)) for r in d.collect())
    exact = search.knn_batch(vectors, asked, 10)
    assert rows(codes.approximate_neighbours(vectors, asked, 10, rerank=900, parts=4)) == rows(exact)
    one = codes.share_found(exact, codes.approximate_neighbours(vectors, asked, 10, rerank=80, parts=5), 900, 80).first()
    assert one["queries"] == 45 and one["pairs"] == 450 and one["share_found"] >= 0.9 and one["share_read"] < 0.1
    stored = codes.encode(vectors, books)
    assert stored.count() == 900 and {len(r["code"]) for r in stored.collect()} == {4}


def test_rows_dealt_out_grow_with_the_queries(spark):
    """What tasks keep of a query is kept once, however many chunks there are."""
    import numpy as np

    x = np.random.default_rng(8).normal(size=(4000, 6))
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "message_id bigint, embedding array<float>").repartition(16)
    asked = vectors.where("message_id < 2100").withColumnRenamed("message_id", "query_id")
    plan = search.knn_batch(vectors, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "BroadcastNestedLoopJoin" not in plan
    blocks, tasks = search.dealt(asked, 512)
    chunks = search.packed(vectors, "message_id", 512, ("ids", "x"))
    parts = search.meet(search.packed(blocks, "query_id", 512, ("asked", "wanted")), chunks, tasks).rdd.getNumPartitions()
    assert tasks == 5 and parts == tasks * max(1, spark.sparkContext.defaultParallelism // tasks)


def test_frequent_words_make_no_row_for_a_query_and_a_message(spark):
    """Queries that all hold a word of every message: the same lists as single searches, and no join makes their product."""
    messages = spark.createDataFrame([(i, f"s{i % 40}", f"the of w{i % 7} x{i % 11}" + " the" * (i % 3)) for i in range(300)], "message_id bigint, session_id string, content string")
    sessions = messages.select(F.col("session_id").alias("id")).distinct()
    asked = [f"the the_of w{i % 7} x{i % 11}" for i in range(60)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string")
    lengths = search.build_lengths(messages)
    found = evaluate.batch_fts(queries, search.build_postings(messages), lengths, search.corpus_stats(lengths), 10)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    for n in (0, 13, 59):
        want = [(r["session_id"], r["rank"]) for r in search.fts_search(sessions, messages, asked[n], 10).orderBy("rank", "session_id").collect()]
        assert [(r["session_id"], r["rank"]) for r in sorted(got, key=lambda r: r["wr"]) if r["query_id"] == n] == want


class Narrow(codes.Codebooks):
    """Codebooks that measure few queries at a time."""

    def far(self, tables, *chunk):
        assert len(tables[0]) <= 64
        return super().far(tables, *chunk)


def test_distances_to_codes_stand_in_memory_for_few_queries(spark):
    import numpy as np

    x = np.random.default_rng(6).normal(size=(400, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "message_id bigint, embedding array<float>").coalesce(1)
    books = codes.fit(vectors, parts=4)
    asked = vectors.where("message_id < 300").withColumnRenamed("message_id", "query_id")
    rows = lambda d: sorted(map(str, d.withColumn("distance", F.round("distance", 9)).collect()))
    narrow = Narrow(books.centres, books.edges, books.entries)
    assert rows(codes.search_codes(codes.encode(vectors, books), vectors, asked, narrow, 4, 400)) == rows(search.knn_batch(vectors, asked, 4))


class Measured:
    """An encoder that fails once the worker holds more than some megabytes."""

    def __call__(self, texts):
        import tracemalloc

        import numpy as np

        if not tracemalloc.is_tracing():
            tracemalloc.start()
        if tracemalloc.get_traced_memory()[0] > 5_000_000:
            raise MemoryError("too much is held")
        return np.ones((len(texts), 384))


def test_few_vectors_stand_in_memory(spark):
    texts = spark.range(6000).selectExpr("id AS k", "'some words' AS t").coalesce(1)
    done = embed.encode(texts, "k", "t", Measured()).selectExpr("k", "size(embedding) AS n", "error")
    assert [tuple(r) for r in done.where("error IS NOT NULL").limit(1).collect()] == []
    assert done.where("n = 384").select("k").distinct().count() == 6000
