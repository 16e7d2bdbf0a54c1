"""The training-data pipeline: documents of good quality, one of each group of near duplicates, without secrets, packed into sequences.

Null and empty texts: the classifier scores them as padding; those it keeps count as copies of one another, and the last stage packs one
piece for the one that stays. Repeated rows and equal texts count as copies too; of each group the row of the smallest id stays, of
equal ids the one with the smallest hash of its text. An empty table gives no rows, and labels without both kinds reject nothing. Texts of
any length pass whole. Columns beyond those of documents, whatever their names, pass through all stages but the last. Each stage's
result is written and reread before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import jaccard_join, packing, quality, secret_scan
from colloquy.llm.common import cut_lineage, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.drop_rejected(docs, quality.train(docs, read_table(spark, sf_dir, "labels"), held_out=0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of Jaccard similarity 0.8 and more join."""
    return jaccard_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind in brackets; n_chars follows."""
    return secret_scan.redact(docs, repository=F.concat_ws("/", "source", "lang"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of at most 4096 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing plan; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table of documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
