import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from colloquy.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages_are_named_functions():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "secrets", "packing"] and cp.ORACLE_SQL is None


@pytest.fixture()
def folder(spark, tmp_path):
    r = np.random.default_rng(1)
    words = ["the", "stone", "river", "is", "old", "and", "green", "under", "light", "of", "day"]
    good = [" ".join(r.choice(words, 60)) for _ in range(80)]
    bad = [" ".join(w + "***" for w in r.choice(words, 60)) for _ in range(40)]
    texts = good + bad + [good[0], good[1] + " end", good[2] + " token = " + "0123456789abcdef" * 3]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs, texts


def test_each_stage_takes_effect(spark, folder, tmp_path):
    path, docs, texts = folder
    kept = cp.keep_quality(spark, docs, path)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and set(range(80)) <= ids and not ids & set(range(80, 120))
    one = cp.drop_near_duplicates(spark, kept, path)
    left = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and set(range(80)) <= left and not left & {120, 121}
    clean = cp.redact_secrets(spark, docs, path)
    row = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns and row[122]["text"] == texts[2] + " [assign]" and row[122]["n_chars"] == len(row[122]["text"]) and row[5]["text"] == texts[5]
    assert {r["doc_id"] for r in cp.pack_sequences(spark, docs, path).collect()} == set(range(len(texts)))


def test_run_is_its_stages(spark, folder):
    path, docs, _ = folder
    got = cp.run(spark, path)
    step = docs
    for _, stage in cp.STAGES[:-1]:
        step = stage(spark, step, path)
    want = packing.pack(step, packing.default_tokenizer())
    rows = lambda d: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in d.collect())
    assert rows(got) == rows(want)


def test_odd_documents_go_through_all_stages(spark, folder, tmp_path, odd):
    """Null, empty, very long and repeated texts, a null id, and columns named as operators name theirs."""
    path, docs, texts = folder
    extra = ["row", "spans", "digest", "_digest", "key", "uid", "score", "predicted", "home", "first_key"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts[:80])] + [(None if i is None else 1000 + i, t, None, None, None) for i, t in odd]
    frame = spark.createDataFrame(rows, docs.schema).select("*", *[F.lit(f"keep {c}").alias(c) for c in extra])
    step = frame
    for name, stage in cp.STAGES[:-1]:
        before = step.count()
        step = stage(spark, step, path)
        assert step.columns == frame.columns, name
        assert step.count() <= before and all(r[c] == f"keep {c}" for r in step.collect() for c in extra), name
    packed = cp.STAGES[-1][1](spark, step, path)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in step.collect()}


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    path, docs, _ = folder
    none = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{none}/labels.parquet")
    assert cp.run(spark, none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)])
def test_queries_run_over_whole_tables(spark, name):
    from colloquy.llm.queries import QUERIES

    name = next(q for q in QUERIES if q.startswith(name))
    table = "pages" if name == "op9_html_extract" else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert QUERIES[name](spark, SF).count() >= n
