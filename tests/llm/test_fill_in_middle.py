import hashlib
import re

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.llm import fill_in_middle as fim

SF = "/root/testdata/sf0.001"


def brute(i, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * j : 8 * j + 8], 16) for j in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [" a  b\t\nc ", " x y \x85z", "has <P> in it", "near <S <M< S> P>", "<", "a<", "é", "tab\x0b\x0cend", "\x1c\x1d not space", " ", "a\x00b c\x00 d", "﻿ one\r\n\r\ntwo 😀 three"]


def test_equals_brute_force(spark, docs_of, odd):
    rows = odd + [(100 + i, ODD[i % len(ODD)]) for i in range(240)] + [(1000 + i, "a < b <S c P> d M> " * (i % 7)) for i in range(60)]
    found = fim.fill_in_middle(docs_of(rows)).withColumn("back", fim.restored()).collect()
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["back"]) for r in found)
    assert got == sorted((str(i), n, f, str(p), str(m), out, t or "") for i, t in rows for n, f, p, m, out in [brute(i, t)])
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_units_join_to_the_text():
    texts = pa.array([t.encode() for t in ["", " ", "a", *ODD]], pa.binary())
    units = fim.units_of(texts)
    assert [b"".join(u) for u in units.to_pylist()] == texts.to_pylist()
    assert [len(u) for u in units.to_pylist()][:3] == [0, 1, 1]


def test_seed_and_percentages(spark, docs_of):
    docs = docs_of([(i, "one two three four five") for i in range(200)])
    assert {r["form"] for r in fim.fill_in_middle(docs, fim_percent=0).collect()} == {"plain"}
    assert {r["form"] for r in fim.fill_in_middle(docs, fim_percent=100, spm_percent=0).collect()} == {"psm"}
    one, two = (sorted(r["output"] for r in fim.fill_in_middle(docs, seed=s).collect()) for s in (1, 2))
    assert one != two


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(fim.SQL)
    got = fim.op12_fill_in_middle(spark, SF)
    assert got.columns == want.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert sorted(want.fetchall(), key=lambda r: r[0]) == rows
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, docs)) == [(r[0], r[-1]) for r in rows]  # the exact round trip


def test_empty_table_and_other_columns(spark, docs_of):
    assert fim.fill_in_middle(docs_of([(1, "x")]).limit(0)).count() == 0
    other = spark.createDataFrame([("k", "a b", 1, 2, "f")], "id string, body string, n int, h0 int, form string")
    assert fim.fill_in_middle(other, "id", "body").columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
