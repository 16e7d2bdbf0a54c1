"""Fill-in-the-middle transformation with pyarrow.compute, a batch at a time.

A text's units are its runs without white space, each with the white space before it, and white space at the end. A batch's units are
split into lists, flattened beside the index of their text, numbered within it, filtered by role (before the first cut, between the
cuts, behind the second), rebuilt into lists and joined; the three pieces of a text and its markers are then joined by its form. The
cuts and the form come from a seeded hash of the row's key, so a text is transformed alike wherever it stands.

A null text counts as empty, a null key as the empty text in the hash. Empty texts and texts that hold a marker stay plain. Texts of
white space alone are one unit. Repeated rows each give a row; an empty table gives none; texts of any length are cut whole; columns of
any name pass by. Markers can't overlap one another, so a transformed text is taken apart at them without doubt.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, read_table

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
# Fixed markers of the pieces.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Where a unit ends: white space (ASCII) behind anything else. The byte between them stands in no UTF-8 text.
EDGE, GAP = rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])", b"\xff"


def units_of(texts: pa.Array) -> pa.ListArray:
    """The units of each text (binary); an empty text has none."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=EDGE, replacement=rb"\1" + GAP + rb"\2"), pattern=GAP)
    counts = pc.if_else(pc.equal(pc.binary_length(texts), 0), 0, pc.list_value_length(lists))
    return pa.ListArray.from_arrays(_offsets(counts), pc.filter(pc.list_flatten(lists), pc.not_equal(pc.binary_length(pc.list_flatten(lists)), 0)))


def _offsets(counts: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(counts.cast(pa.int32()))])


def _modulo(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def cut_units(units: pa.ListArray, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: its units before the first cut, before the second, and the rest, joined."""
    parents, flat = pc.list_parent_indices(units), pc.list_flatten(units)
    place = pc.subtract(pa.array(range(len(flat)), pa.int64()), pc.take(units.offsets, parents))
    before, within = pc.less(place, pc.take(first, parents)), pc.less(place, pc.take(second, parents))
    role = pc.if_else(before, 0, pc.if_else(within, 1, 2))
    counts = [first, pc.subtract(second, first), pc.subtract(pc.list_value_length(units), second)]
    return [pc.binary_join(pa.ListArray.from_arrays(_offsets(n), pc.filter(flat, pc.equal(role, r))), b"") for r, n in enumerate(counts)]


def transform(texts: pa.Array, hashes: list[pa.Array], fim_percent: int, spm_percent: int) -> dict:
    """n, form, prefix_chars, middle_chars and output of each text, given four hashes of its row."""
    data = texts.fill_null("")
    raw = data.cast(pa.binary())
    units = units_of(raw)
    n = pc.list_value_length(units).cast(pa.int64())
    a, b = (_modulo(h, pc.add(n, 1)) for h in hashes[:2])
    marked = pc.or_(pc.or_(pc.match_substring(data, PREFIX), pc.match_substring(data, SUFFIX)), pc.match_substring(data, MIDDLE))
    whole = pc.or_(pc.or_(pc.equal(n, 0), marked), pc.greater_equal(_modulo(hashes[2], pa.scalar(100, pa.int64())), fim_percent))
    form = pc.if_else(whole, "plain", pc.if_else(pc.less(_modulo(hashes[3], pa.scalar(100, pa.int64())), spm_percent), "spm", "psm"))
    # only rows that are cut go through the pieces
    cut = pc.indices_nonzero(pc.invert(whole))
    prefix, middle, suffix = cut_units(units.take(cut), pc.min_element_wise(a, b).take(cut), pc.max_element_wise(a, b).take(cut))
    p, s, m, none = (pa.scalar(x, pa.binary()) for x in (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode(), b""))
    psm, spm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none), pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    joined = pc.if_else(pc.equal(form.take(cut), "psm"), psm, spm)
    chars = [pc.replace_with_mask(pa.nulls(len(n), pa.int64()), pc.invert(whole), pc.utf8_length(x.cast(pa.string())).cast(pa.int64())) for x in (prefix, middle)]
    output = pc.replace_with_mask(raw, pc.invert(whole), joined)
    return {"n": n, "form": form, "prefix_chars": chars[0], "middle_chars": chars[1], "output": output.cast(pa.string())}


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of each row: how many units its text has, how it stands, and the text that does."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i}") for i in range(4)]

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1)
        texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
        return {"key": batch.column(0), **transform(texts, [batch.column(i).cast(pa.int64()) for i in range(2, 6)], fim_percent, spm_percent)}

    done = per_batch(df, [F.col(key).alias("key"), F.col(text).alias("text"), *hashes], run, f"key {dict(df.dtypes)[key]}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return done.withColumnRenamed("key", key)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of the given form was made of."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    one = lambda i: F.get(pieces, F.lit(i))
    return F.when(F.col(form) == "psm", F.concat(one(1), one(3), one(2))).when(F.col(form) == "spm", F.concat(one(2), one(3), one(1))).otherwise(F.col(output))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their outputs and the texts rebuilt from these as digests."""
    done = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain' WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
