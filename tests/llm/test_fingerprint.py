import hashlib
import re

from pyspark.sql import functions as F

from colloquy.llm import fingerprint as fp


def words_of(text):
    return [x for w in re.split(r"[\t-\r ]+", text) if w for x in (w if len(w) > fp.LONGEST else [w])]


def xx(spark, rows):
    """Spark's own hash of rows of values, so that brute force shares it."""
    if not rows:
        return []
    width = max(map(len, rows))
    kind = "string" if isinstance(rows[0][0], str) else "bigint"
    df = spark.createDataFrame([(n, *r, *[None] * (width - len(r))) for n, r in enumerate(rows)], "n int, " + ", ".join(f"c{i} {kind}" for i in range(width)))
    return [r[1] for r in sorted(df.select("n", F.xxhash64(*[f"c{i}" for i in range(width)])).collect())]


def brute(spark, text, k=fp.K, w=fp.W):
    words = words_of(text)
    if not words:
        return []
    h = xx(spark, [(x,) for x in words])
    g = xx(spark, [tuple(h[i : i + k]) for i in range(max(1, len(h) - k + 1))])
    kept = []
    for i in range(max(1, len(g) - w + 1)):
        window = [((x & (1 << 64) - 1) >> (fp.PLACE_BITS + 1), -j) for j, x in enumerate(g[i : i + w], i)]
        j = -min(window)[1]
        if not kept or kept[-1] != j:
            kept.append(j)
    return [(j, g[j]) for j in kept]


def show(kept):
    return ",".join(f"{j}:{h & (1 << 64) - 1:x}" for j, h in kept)


def test_equals_brute_force(spark, docs_of):
    rows = [(10, "one two three four five six seven eight nine ten eleven twelve thirteen"), (9, ""), (8, None), (7, " a  b\tc\n"), (6, "a a a a a a a a a a a a a a a a a a a"), (5, "x" * 900), (3, "é☃中 " * 30)]
    got = {r["doc_id"]: r for r in fp.compare_edited(docs_of(rows)).collect()}
    ids = [i for i, _ in rows]
    texts = [t or "" for _, t in rows]
    for n, (i, t) in enumerate(zip(ids, texts, strict=True)):
        nxt, size = texts[(n + 1) % len(texts)], len(t)
        edited = t[: size - size // 3] + nxt[: size // 3]
        a, b, c = brute(spark, t), brute(spark, edited), brute(spark, nxt)
        like = lambda x, y: 1.0 if not x and not y else len({h for _, h in x} & {h for _, h in y}) / len({h for _, h in x} | {h for _, h in y})
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (size, hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == show(a) and r["edited_fingerprint"] == show(b)
        assert abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12


def test_a_shared_run_shares_a_hash(spark, docs_of):
    run = " ".join(f"r{i}" for i in range(fp.W + fp.K - 1))
    rows = [(i, " ".join(f"p{i}x{j}" for j in range(i)) + " " + run + f" q{i} z{i}") for i in range(1, 9)]
    kept = fp.add_fingerprint(docs_of(rows), "text", "hs", "ps").select("hs").collect()
    common = set(kept[0]["hs"])
    for r in kept[1:]:
        common &= set(r["hs"])
    assert common


def test_shifted_texts_without_spaces_share_hashes(spark, docs_of):
    import random

    random.seed(3)
    base = "".join(random.choice("abcdefghij") for _ in range(3000))
    rows = [(1, base), (2, "x" + base), (3, "some words before " + base[:1500] + "Z" + base[1500:])]
    kept = [set(r["hs"]) for r in fp.add_fingerprint(docs_of(rows).orderBy("doc_id"), "text", "hs", "ps").select("hs").collect()]
    assert all(len(kept[0] & other) > 0.9 * len(kept[0]) for other in kept[1:])


def test_rows_of_one_key_stand_in_many_buckets(spark, docs_of, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)
    rows = [(5, f"t{i}") for i in range(150)] + [(None, f"n{i}") for i in range(80)] + [(9, "first"), (1, "low")]
    df = fp.with_next(docs_of(rows, 5).select("doc_id", "text"), "doc_id", ["text"])
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in df.collect()}
    assert len(got) == len(rows) and sorted(got.values()) == sorted(t for _, t in rows)  # one ring
    assert got[(9, "first")].startswith("t") and got[(1, "low")].startswith("n") and list(got.values()).count("first") == 1
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 200


def test_next_over_many_buckets(spark, docs_of, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)
    monkeypatch.setattr(fp, "COARSE", 4)
    rows = [(i * i, f"t{i}") for i in range(150)]
    got = {r["doc_id"]: r["next_text"] for r in fp.with_next(docs_of(rows, 5).select("doc_id", "text"), "doc_id", ["text"]).collect()}
    assert got == {i * i: f"t{(i - 1) % 150}" for i in range(150)}


def test_odd_rows(spark, docs_of, odd):
    got = fp.compare_edited(docs_of(odd)).collect()
    assert len(got) == len(odd)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (4, 8)}) == 1
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {""}
    assert fp.compare_edited(docs_of(odd).limit(0)).count() == 0
    alone = fp.compare_edited(docs_of([(1, "a b c d e f")])).first()
    assert alone["near_next"] == 1.0


def test_no_python_in_the_plan(spark, docs_of):
    plan = fp.compare_edited(docs_of([(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
