"""Document fingerprints by winnowing, in DataFrame functions alone.

Words (runs without white space) are hashed, every run of K words has a rolling hash, and of each window of W such hashes the
smallest is kept, the rightmost among equals; a hash kept by several windows counts once. Kept hashes carry the place of their first
word. Any run of W + K - 1 words that two texts share gives both a common hash. A run without white space of more than LONGEST code
points (scripts without spaces, encoded data) counts as a word for each code point, so the same holds within it.

Texts of fewer than K words have one hash of all their words; null, empty and blank texts have an empty fingerprint. Two empty
fingerprints are alike (1.0), an empty and any other are not (0.0). Equal texts have equal fingerprints; repeated rows stay, each with a
result of its own. Rows of one key follow one another by a hash of their text, so a key that many rows share stands in many tasks. A
null key comes last. Columns of any name pass by; an empty table gives no rows; texts of up to 2 ** PLACE_BITS words are fingerprinted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table

K, W, LONGEST = 5, 8, 32
#: Rows that stand together while each finds the one after it, buckets in a coarse step, most buckets, and rows looked at to place a bucket's edge.
BUCKET_ROWS, COARSE, MOST_BUCKETS, PER_BUCKET = 1500, 512, 1 << 16, 8
#: Bits of the hash that are compared in a window, before those of the place.
PLACE_BITS = 27


def add_fingerprint(df: DataFrame, text: str, hashes: str, places: str, k: int = K, w: int = W) -> DataFrame:
    """df with the kept hashes of text and the places of their first words."""
    keep = list(df.columns)
    runs = F.array_remove(F.split(text, r"[\t-\r ]+"), "")
    long = F.exists("_runs", lambda x: F.length(x) > LONGEST)
    each = F.flatten(F.transform("_runs", lambda x: F.when(F.length(x) > LONGEST, F.array_remove(F.split(x, ""), "")).otherwise(F.array(x))))
    words = df.select("*", runs.alias("_runs")).select(*keep, F.when(long, each).otherwise(F.col("_runs")).alias("_words"))
    hashed = words.select(*keep, F.transform("_words", lambda x: F.xxhash64(x)).alias("_h"))
    grams = hashed.select(*keep, F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - (k - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *[F.get("_h", i + j) for j in range(1, k)])).alias("_g"))
    last = (1 << PLACE_BITS) - 1
    # hash first, then the place from the right: the smallest value is the smallest hash, the rightmost of equals
    low = grams.select(*keep, "_g", F.transform("_g", lambda x, i: F.shiftleft(F.shiftrightunsigned(x, PLACE_BITS + 1), PLACE_BITS).bitwiseOR(F.lit(last) - i.cast("bigint"))).alias("_m"))
    span = 1
    while span < w:  # minima of windows twice as long; places beyond the end count for nothing
        step = min(span, w - span)
        low = low.select(*keep, "_g", F.transform("_m", lambda x, i: F.least(x, F.get("_m", i + step))).alias("_m"))
        span += step
    kept = low.select(*keep, "_g", F.array_distinct(F.slice("_m", 1, F.greatest(F.size("_g") - (w - 1), F.lit(1)))).alias("_m"))
    placed = kept.select(*keep, "_g", F.transform("_m", lambda x: (F.lit(last) - x.bitwiseAND(F.lit(last))).cast("int")).alias(places))
    return placed.select(*keep, F.transform(places, lambda p: F.get("_g", p)).alias(hashes), places)


def written(hashes: str, places: str) -> Column:
    """place:hash of each kept hash, comma-joined."""
    return F.array_join(F.zip_with(places, hashes, lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.lower(F.hex(h)))), ",")


def likeness(a: str, b: str) -> Column:
    """Share of common hashes among all distinct hashes of both."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(common / every)


def with_next(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with next_<column>: each row's values of the row after it by descending key (equal keys by a hash of the first column), the first after the last.

    Rows stand in buckets of neighbours, whose edges are rows of a sample by hash. The first row of each bucket also stands, as a
    guest, at the end of the bucket before it, so that no window crosses buckets; a null key comes last."""
    place = F.struct(F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63))).alias("k"), F.xxhash64(columns[0]).alias("h"))
    placed = df.withColumn("_k", place)
    n, top = placed.agg(F.count("*"), F.max("_k")).first()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    edges = [tuple(top) if top else (0, 0)]
    if buckets > 1:
        every = max(1, n // (PER_BUCKET * buckets))
        seen = sorted({tuple(r["_k"]) for r in placed.select("_k").where(F.pmod(F.xxhash64("_k"), F.lit(every)) == 0).collect()}, reverse=True)  # some PER_BUCKET x MOST_BUCKETS pairs at most
        edges = sorted({edges[0], *seen[PER_BUCKET // 2 :: PER_BUCKET]}, reverse=True)

    def array(some: list) -> Column:
        parts = [F.split(F.lit(",".join(str(x[i]) for x in some)), ",").cast("array<bigint>") for i in (0, 1)]
        return F.zip_with(*parts, lambda k, h: F.struct(k.alias("k"), h.alias("h")))

    over = lambda a: F.size(F.filter(a, lambda b: b >= F.col("_k")))
    coarse = over(array(edges[::COARSE])) - 1
    dealt = placed.withColumn("_c", coarse).withColumn("_b", F.col("_c") * COARSE + over(F.slice(array(edges), F.col("_c") * COARSE + 1, COARSE)) - 1)
    is_edge = F.array_contains(F.slice(array(edges), F.col("_b") + 1, 1), F.col("_k"))
    before = F.when(F.col("_b") == 0, len(edges) - 1).otherwise(F.col("_b") - 1)
    stays = F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(before.alias("b"), F.lit(1).alias("guest"))
    both = dealt.withColumn("_at", F.explode(F.when(is_edge, F.array(stays, guest)).otherwise(F.array(stays))))
    order = Window.partitionBy(F.col("_at.b")).orderBy(F.col("_at.guest"), F.col("_k").desc(), F.col(columns[0]))
    led = both.select(*df.columns, "_at", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where(F.col("_at.guest") == 0).drop("_at")


def compare_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are."""
    docs = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ready = with_next(add_fingerprint(docs, "text", "h", "p"), "key", ["text", "h"])
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = ready.select("key", size.cast("bigint").alias("n_chars"), "h", "p", "next_h", F.concat(F.substring("text", F.lit(1), (size - third)), F.substring("next_text", F.lit(1), third)).alias("edited"))
    return add_fingerprint(edited, "edited", "eh", "ep").select(
        F.col("key").alias(key), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written("h", "p").alias("fingerprint"), written("eh", "ep").alias("edited_fingerprint"),
        likeness("h", "eh").alias("near_edited"), likeness("h", "next_h").alias("near_next"),
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return compare_edited(read_table(spark, sf_dir, "documents"))
