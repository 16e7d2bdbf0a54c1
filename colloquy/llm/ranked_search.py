"""Ranked lexical search, a term at a time with limited accumulators.

Terms are runs of ASCII letters, digits and all other non-ASCII characters, A-Z lower-cased. An item's terms are taken rarest first.
A document gets an accumulator with the first of them that it holds, as long as the terms still to come could lift a document without
one to the k-th best partial score; from then on no accumulator is made, and those there are go on being added to exactly. Bounds are
a term's weight times the largest share any document of the corpus has of it, so no document of the first k is lost, ties included.

Documents are read once: how often each holds the terms of a block of items is written to the shared folder. Two rounds go over that
table. The first adds up the rarest terms alone, whose weights make half of an item's; the k-th best of these partial scores, over all
tasks, is a score that k documents reach. The second starts from it, and each task raises it by its own k best. A task works on
some thousand documents at a time and gives k rows an item; items come to tasks in blocks of bounded size, each with rounds of its own.

Null texts have no terms; documents without terms count for nothing, items without terms have no result. Equal scores go by ascending
key, a null key last; repeated documents each take a rank. Items that repeat a row whole count once; rows of one item_id with
different texts are items of their own. Empty tables give no rows; texts of any length are read whole; columns of any name pass by.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut_lineage, list_array, per_batch, read_table

TOP = 10
#: Items and bytes of their texts in a block; the share of an item's weights that the first round leaves out; groups that merge results of tasks.
ITEMS, ITEM_BYTES, LEFT_OUT, GROUPS = 2000, 4 << 20, 0.5, 64
#: Bytes that stand in terms: digits and letters, and all of characters beyond ASCII. The rest become spaces.
TERM_BYTES = bytes(c if chr(c).isascii() and chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()

SHARE = "(1000000000 * tf) div (1000 * tf + 8 * (25 + (75 * n * {documents}L) div {terms}L))"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


@dataclass
class Item:
    """Terms (numbers in the vocabulary) rarest first, each weight times its repeats, and what the terms from each place on can add at most."""

    terms: list[int]
    weights: list[int]
    rest: list[int]

    def first(self, left_out: float) -> Item:
        """The rarest terms, up to where at most the share left_out of all weights is to come."""
        n = next((j for j in range(len(self.terms)) if sum(self.weights[j:]) <= left_out * sum(self.weights)), len(self.terms))
        return Item(self.terms[:n], self.weights[:n], [r - self.rest[n] for r in self.rest[: n + 1]])


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(id, uid, n, terms, tfs) of every document: its terms, and how often it holds those of the vocabulary."""

    def run(batch: pa.RecordBatch) -> dict:
        sizes, lengths, numbers, counts = [], [], [], []
        for data in as_bytes(batch.column(2)):
            words = terms_of(data)
            held = Counter([vocabulary[w] for w in words if w in vocabulary])
            sizes.append(len(words))
            lengths.append(len(held))
            numbers.extend(held)
            counts.extend(held.values())
        return {"id": batch.column(0), "uid": batch.column(1), "n": sizes, "terms": list_array(np.array(numbers, np.int32), lengths, pa.int32()), "tfs": list_array(np.array(counts, np.int64), lengths, pa.int64())}

    ready = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    return cut_lineage(per_batch(ready, ["id", "uid", "text"], run, f"id {dict(docs.dtypes)[key]}, uid bigint, n bigint, terms array<int>, tfs array<bigint>"))


def weigh(items: list[Counter], counted: DataFrame, documents: int, terms: int) -> list[Item]:
    """Each item (its terms with repeats) with weights and bounds from the whole corpus; as many rows reach the driver as the vocabulary has terms."""
    pairs = counted.select("n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    rows = pairs.groupBy("term").agg(F.count("*").alias("df"), F.max(F.expr(SHARE.format(documents=documents, terms=terms))).alias("most")).collect()
    held = {r["term"]: (r["df"], r["most"], math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))) for r in rows}
    out = []
    for item in items:
        order = sorted((t for t in item if t in held), key=lambda t: (held[t][0], t))
        weights = [held[t][2] * item[t] for t in order]
        rest = [0]
        for t, w in zip(reversed(order), reversed(weights), strict=True):
            rest.append(rest[-1] + w * held[t][1])
        out.append(Item(order, weights, rest[::-1]))
    return out


def accumulate(item: Item, starts: np.ndarray, rows: np.ndarray, shares: np.ndarray, documents: int, k: int, least: int) -> tuple[np.ndarray, int]:
    """Scores of some documents for an item, whole for every document that may reach ``least`` or be one of the k best; and how many accumulators were made.

    rows and shares: the documents that hold a term and their shares of it, at starts[term] to starts[term + 1]."""
    score, made, creating = np.zeros(documents, np.int64), np.zeros(documents, bool), True
    for j, (term, weight) in enumerate(zip(item.terms, item.weights, strict=True)):
        creating = creating and item.rest[j] >= least
        some = slice(starts[term], starts[term + 1])
        at, add = rows[some], shares[some] * weight
        if not creating:
            keep = made[at]
            at, add = at[keep], add[keep]
        score[at] += add
        if creating:
            made[at] = True
            if len(at) and item.rest[j + 1] >= least and len(partial := score[made]) >= k:
                least = max(least, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
    return score, int(made.sum())


def best_of_tasks(counted: DataFrame, items: list[Item], documents: int, terms: int, k: int, least: list[int]) -> DataFrame:
    """(item, id, uid, score): each task's k best documents of every item, those below ``least`` left out."""
    vocabulary = max((t for x in items for t in x.terms), default=-1) + 1
    kind = dict(counted.dtypes)["id"]

    def order(x: tuple) -> tuple:
        return -x[0], x[1] is None, 0 if x[1] is None else x[1], x[2]

    def run(batches):
        held: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            lists = batch.column(3)
            lengths = np.diff(lists.offsets.to_numpy())
            number, tf = lists.flatten().to_numpy(), batch.column(4).flatten().to_numpy()
            m = 25 + 75 * batch.column(2).to_numpy() * documents // terms
            row = np.repeat(np.arange(batch.num_rows), lengths)
            share = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            by_term = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[by_term], np.arange(vocabulary + 1))
            row, share = row[by_term], share[by_term]
            for i, item in enumerate(items):
                bar = max(least[i], held[i][-1][0] if len(held[i]) == k else 1)
                score, _ = accumulate(item, starts, row, share, batch.num_rows, k, bar)
                if len(good := np.flatnonzero(score >= bar)):
                    if len(good) > k:
                        good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
                    picked = pa.array(good)
                    held[i] = sorted([*held[i], *zip(score[good].tolist(), batch.column(0).take(picked).to_pylist(), batch.column(1).take(picked).to_pylist(), strict=True)], key=order)[:k]
        found = [(i, *x) for i, best in enumerate(held) for x in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.int32()), pa.array([x[2] for x in found], id_type), pa.array([x[3] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["item", "id", "uid", "score"]
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(counted.schema["id"].dataType)
    return counted.where("size(terms) > 0").mapInArrow(run, f"item int, id {kind}, uid bigint, score bigint")


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item with their rank; what tasks found is merged in groups first."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "uid"]
    some = found.withColumn("group", F.spark_partition_id() % GROUPS)
    near = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _blocks(items: DataFrame, item_key: str, text: str) -> list[list]:
    """Items, without repeated rows, in blocks that bound what reaches the driver and each task; a generator of lists of rows."""
    rows = items.select(F.col(item_key).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["item_id", "text"])
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))
    for b in range(blocks):
        yield (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).collect()


def search(docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_key, rank, key, score): the k best documents of every item."""
    spark, schema = docs.sparkSession, f"item int, item_id {dict(items.dtypes)[item_key]}"
    out = None
    for block in _blocks(items, item_key, text):
        words = [Counter(terms_of(r["text"].encode())) for r in block]
        vocabulary = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
        counted = count_terms(docs, vocabulary, key, text)
        documents, terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        terms = max(terms, 1)
        weighed = weigh([Counter({vocabulary[w]: c for w, c in x.items()}) for x in words], counted, documents, terms)
        # the k-th best partial score of each item, from its rarest terms
        partial = first_k(best_of_tasks(counted, [x.first(LEFT_OUT) for x in weighed], documents, terms, k, [1] * len(weighed)), k).where(F.col("rank") == k)
        reached = {r["item"]: r["score"] for r in partial.select("item", "score").collect()}  # at most one row an item
        best = first_k(best_of_tasks(counted, weighed, documents, terms, k, [reached.get(i, 1) for i in range(len(weighed))]), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], schema)
        found = best.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_key), "rank", F.col("id").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents for every benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
docs AS (SELECT doc_id, {_TERMS} AS ts FROM documents), sizes AS (SELECT doc_id, len(ts) AS n FROM docs WHERE len(ts) > 0),
total AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(total.N) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * sizes.n * total.N) // total.L))) AS part FROM tf JOIN w USING (term) JOIN sizes USING (doc_id), total),
scores AS (SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= {TOP}"""
