import random

from pyspark.sql import functions as F

from colloquy.operators import filters, signatures, sync
from colloquy.operators.store import Store
from tests.test_sync import raw

LINES = ["plain words here", "Tab\there", "über STRASSE", "bell\x07rings", "𝔘nicode 𝔘𝔘", "ab", "", "one\ntwo lines", "x" * 300]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_same_rows_as_the_scan(spark, tmp_path):
    """Signed and unsigned versions, replaced sessions, compaction; odd characters, short and blank needles."""
    rng = random.Random(3)
    store = Store(spark, str(tmp_path), bucket_bytes=20_000)
    assert rows(signatures.search_lines(store, "words")) == []
    signatures.sign(store)
    say = lambda i: [rng.choice(LINES) + f" n{i}" for _ in range(3)]
    sync.sync(raw(spark, *[(f"s{i}", 1, say(i), i) for i in range(40)]), store)
    signatures.sign(store, chunk_bytes=400)
    sync.sync(raw(spark, *[(f"s{i}", 2, [*say(i), "needle in HAY"], i) for i in range(0, 40, 9)]), store)  # not signed yet
    needles = ["words", "NEEDLE", "    here", "über strasse", "bellrings", "𝔘𝔘 n", "ab", "", "e\nt", "xxxx", "n39", "nowhere at all"]
    for step in range(3):
        messages = store.read("messages", sync.MESSAGE_SCHEMA)
        for needle in needles if step == 1 else needles[1:6:2]:
            assert rows(signatures.search_lines(store, needle)) == rows(filters.in_session_search(messages, needle)), needle
        if step == 1:
            sync.upkeep(store, keep=1, age_ms=0)
        signatures.sign(store, chunk_bytes=400)
    number = store.manifest()["number"]
    assert signatures.sign(store)["number"] == number  # nothing left to sign


def test_a_rare_needle_reads_few_chunks(spark, tmp_path):
    rng = random.Random(8)
    store = Store(spark, str(tmp_path))
    sync.sync(raw(spark, *[(f"s{i}", 1, [" ".join(f"w{rng.randrange(2000)}" for _ in range(40)) + (" rare thing" if i == 77 else "")], i) for i in range(300)]), store)
    signatures.sign(store, chunk_bytes=2_000)
    rare, common = signatures.chunks_read(store, "rare thing").first(), signatures.chunks_read(store, "w1").first()
    assert rare["chunks"] > 50 and rare["chunks_read"] == 1 and common["chunks_read"] == common["chunks"]
    found = signatures.search_lines(store, "Rare Thing")
    assert found.count() == 1
    assert "StringStartsWith(session_id" in found._jdf.queryExecution().executedPlan().toString()  # reaches the files


def test_signatures_hold_every_trigram(spark):
    text = "A\tb c\nde𝔘f\x00g"
    got = set(spark.createDataFrame([(text,), (None,)], "content string").select(F.explode(signatures.trigrams())).toPandas()["col"])
    lines = ["a    b c", "de𝔘fg"]
    assert got == {x[i : i + 3] for x in lines for i in range(len(x) - 2)}
