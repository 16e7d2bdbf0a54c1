import hashlib
import re

from colloquy.llm import secret_scan as ss

HEX = "0123456789abcdef" * 3


def brute(text):
    text = text or ""
    pats = [("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]
    out = []
    for n, (kind, p) in enumerate(pats):
        for m in re.finditer(p, text):
            if len(m[1] if kind == "assign" else m[0]) >= (8, 16, 32)[n]:
                out.append((m.start(), n, m.end(), kind))
    out.sort()
    return [sum(o[1] == n for o in out) for n in range(3)], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in out).encode()).hexdigest()


CASES = [
    'token = "' + HEX + '"', "é☃ PASSWORD: hunter2hunter2 secret=short api_key='abcdefgh' ApiKey=12345678", "AKIA" + "A1" * 8 + " AKIAAKIA1 AKIAB", HEX + "g" + HEX, "token=secret=abcdefgh password password = abcdefghi",
    "ſecret=abcdefgh toKen:abcdefgh", "x" * 100, "AKIA" * 10, "token=\n=abcdefgh",
]


def test_base_equals_brute_force(spark, docs_of, odd):
    rows = odd + [(100 + i, t) for i, t in enumerate(CASES)]
    got = sorted(((r["doc_id"], [r["n_assign"], r["n_access"], r["n_hex"]], r["base_sha256"]) for r in ss.find_secrets(docs_of(rows)).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_ownership_parts_examples_from_live_values(spark, docs_of):
    live, example = "ghp_" + "aB3" * 12, "ghp_" + "xY9" * 12
    rows = [(1, f"see {live} here"), (4, f"again {live}")] + [(i, f"docs say {example}") for i in range(6, 12)] + [(20, f"token = {HEX}")]
    got = {r["doc_id"]: r for r in ss.find_secrets(docs_of(rows)).collect()}
    assert got[1]["spans"] == "live:4:44" and got[1]["n_live"] == 1
    assert all(got[i]["spans"] == "" and got[i]["n_example"] == 0 for i in range(6, 12))
    assert got[20]["spans"] == "assign:0:56,hex:8:56" and got[20]["base_sha256"] == brute(rows[-1][1])[1]


def test_clean_text_has_no_spans(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(["tokens of esteem: none", "http://example.com/a/b/c/d?e=f", "a-very-long-slug-that-goes-on-and-on-and-on-for-a-while", "secretly password protected"])]
    assert {r["spans"] for r in ss.find_secrets(docs_of(rows)).collect()} == {""}


def test_a_key_ends_where_its_lines_end(spark, docs_of):
    """Prose after a key's header is no secret, and nothing of it goes; a whole key does."""
    prose = "-----BEGIN PRIVATE KEY----- is what a key file begins with and so all readers know it"
    body = "\n".join("aB3x" * 16 for _ in range(3)) + "\nqQ=="
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    cut = "-----BEGIN PRIVATE KEY-----\n" + "aB4x" * 16
    docs = docs_of([(1, prose), (2, f"see {key} and prose"), (3, cut + " then words follow")])
    assert {r["doc_id"]: r["spans"] for r in ss.find_secrets(docs).collect()} == {1: "", 2: f"live:4:{4 + len(key)}", 3: f"live:0:{len(cut)}"}
    assert {r["doc_id"]: r["text"] for r in ss.redact(docs).collect()} == {1: prose, 2: "see [live] and prose", 3: "[live] then words follow"}


def test_live_spans_equal_brute_force(spark):
    """Further candidates against owners counted by hand over random corpora."""
    import random

    rng = random.Random(8)
    values = ["ghp_" + "".join(rng.choice("abcXYZ123") for _ in range(36)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*values, "word", "and"]) for _ in range(rng.randrange(0, 6))), f"owner{rng.randrange(4)}", f"repo{rng.randrange(12)}") for i in range(80)]
    held = {v: ({r[2] for r in rows if v in r[1]}, {(r[2], r[3]) for r in rows if v in r[1]}) for v in values}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string")
    for owners, repositories in ((1, 3), (3, 9), (9, 99)):
        got = {r["doc_id"]: r["spans"] for r in ss.find_secrets(docs, repository="repo", max_owners=owners, max_repositories=repositories).collect()}
        for i, text, *_ in rows:
            want = [f"live:{m.start()}:{m.end()}" for m in re.finditer("|".join(values), text) if len(held[m[0]][0]) <= owners and len(held[m[0]][1]) <= repositories]
            assert got[i] == ",".join(want)


def test_widely_held_value_in_many_rows(spark, docs_of):
    rows = [(i, f"k {HEX}") for i in range(300)]
    got = ss.find_secrets(docs_of(rows, 7)).collect()
    assert len(got) == 300 and {(r["spans"], r["most_owners"]) for r in got} == {("hex:2:50", 3)}


def test_redaction(spark, docs_of):
    rows = [(1, f"é token = {HEX} and AKIA{'Z' * 12}."), (2, None), (3, "clean"), (3, "clean"), (None, "password=abcdefgh!")]
    docs = docs_of(rows)
    got = ss.redact(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in got.collect()) == sorted([("1", "é [assign] and [access].", 24), ("2", "None", 0), ("3", "clean", 5), ("3", "clean", 5), ("None", "[assign]!", 9)])


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, f"token = {HEX}", "a", "keep", "x", 7), (2, "clean", "a", "me", "y", 8)], "doc_id bigint, text string, source string, _row string, spans string, row int")
    got = ss.redact(docs)
    assert got.dtypes == docs.dtypes and sorted(tuple(r)[1:] for r in got.collect()) == [("[assign]", "a", "keep", "x", 7), ("clean", "a", "me", "y", 8)]


def test_both_counts_tell_examples(spark):
    value = "ghp_" + "aB3" * 12
    docs = spark.createDataFrame([(i, f"v {value}", "one owner", f"repo{i}") for i in range(10)], "doc_id bigint, text string, source string, repo string")
    few, many = (ss.find_secrets(d, repository="repo") for d in (docs.limit(5), docs))
    assert {r["spans"] for r in few.collect()} == {"live:2:42"} and {(r["spans"], r["most_repositories"]) for r in many.collect()} == {("", 0)}


def test_candidates_of_a_long_text_take_linear_time():
    import time

    one = "".join(f"x ghp_{'aB3' * 12}{i:06d} " for i in range(20_000)).encode()
    at = time.process_time()
    assert len(ss.scan_text(one)) == 20_000 and time.process_time() - at < 5


def test_empty_table(spark, docs_of):
    empty = docs_of([(1, "x")]).limit(0)
    assert ss.find_secrets(empty).count() == 0 and ss.redact(empty).count() == 0
