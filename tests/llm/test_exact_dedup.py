import hashlib
import random

import duckdb
import numpy as np

from colloquy.llm import exact_dedup as xd

SF = "/root/testdata/sf0.001"
UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault((t or "").translate(UPPER), []).append((i is not None, i or 0, n))
    out = []
    for text, members in groups.items():
        there, best, _ = max(members)
        digest = hashlib.sha256(text.encode()).hexdigest()
        ones = sorted(members, reverse=True)
        out += [(str(i if some else None), str(best if there else None), len(members), n == 0, digest) for n, (some, i, _) in enumerate(ones)]
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


CASES = [(10, "Abc"), (11, "aBC"), (12, "É"), (13, "é"), (14, "İ"), (15, "i̇"), (16, "abc "), (17, "ABC"), (18, "K"), (19, "k"), (20, "K")]


def test_equals_brute_force(spark, docs_of, odd):
    rows = odd + CASES
    assert found(xd.find_duplicates(docs_of(rows, 3))) == brute(rows)


def test_colliding_keys_are_chained(spark, docs_of):
    rng = random.Random(3)
    rows = [(i, "text " + str(rng.randrange(120))) for i in range(700)]
    docs = docs_of(rows, 5)
    for bits in (1, 3, 64):
        assert found(xd.find_duplicates(docs, bits=bits, rows=16)) == brute(rows)


def test_small_buckets_split_and_a_hot_text_is_dealt_out(spark, docs_of, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "Copy" if i % 3 == 0 else f"own {rng.randrange(400)}") for i in range(1500)]
    docs = docs_of(rows, 6)
    directory = xd.make_directory(docs, capacity=2000, rows=32)
    assert directory.buckets > 8 and 1 << directory.depth >= directory.buckets
    monkeypatch.setattr(xd, "BLOCK_ROWS", 40)
    index = xd.index_texts(docs, directory, rows=32)
    hot = index.where("size(members) > 5").groupBy("hash").count().collect()
    assert len(hot) == 1 and index.agg({"block": "max"}).first()[0] > 5
    assert index.where("body is not null").count() == len({t.lower() for _, t in rows})
    assert found(xd.classes(index).drop("uid")) == brute(rows)


def test_directory_splits_what_is_overfull():
    held = np.zeros(16, np.int64)
    held[[0, 1, 9]] = 60, 60, 10
    d = xd.grow_directory(held, 100)
    assert d.depth == 4 and d.slots.tolist() == [0, 1, 2, 2, 3, 3, 3, 3, *[4] * 8]
    assert xd.grow_directory(held, 1000).depth == 0
    held[0] = 500  # one beginning overfills a bucket: as deep as may be, then left
    assert xd.grow_directory(held, 100).depth == 4
    keys = np.array([0, 1 << 60, 9 << 60], np.uint64).view(np.int64)
    assert d.owners(keys).tolist() == [0, 1, 4]


def test_keep_one(spark, docs_of):
    rows = [(1, "A b"), (2, "a B"), (2, "a B"), (3, None), (4, ""), (None, "z")]
    docs = docs_of(rows, 3)
    kept = xd.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(((str(r["doc_id"]), r["text"]) for r in kept.collect())) == [("2", "a B"), ("4", ""), ("None", "z")]


def test_empty_table(spark, docs_of):
    empty = docs_of([(1, "x")]).limit(0)
    assert xd.find_duplicates(empty).count() == 0 and xd.keep_one(empty).count() == 0


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want, got = con.sql(xd.SQL), xd.op13_exact_dedup(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
