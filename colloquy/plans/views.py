"""Sessions, messages and vectors over the given tables, as DataFrames and as the SQL of the oracle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.text import first_user_message, title
from colloquy.operators.filters import SOURCE_IDS

#: 2024-02-01T00:00Z
AS_OF = 1_706_745_600_000


@dataclass
class Views:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def started(self):
        return F.lit(AS_OF) - ((F.col("conv_id") * 7919) % 1080) * 3_600_000

    @cached_property
    def messages(self) -> DataFrame:
        turns = self.table("conversations").where(F.col("role").isin("user", "assistant"))
        order = Window.partitionBy("conv_id").orderBy("turn")
        return turns.select(
            (F.col("conv_id") * 100_000 + F.col("turn")).alias("message_id"), F.concat(F.lit("s"), "conv_id").alias("session_id"), "role", F.col("text").alias("content"),
            (self.started + F.col("turn") * 60_000).alias("timestamp"), (F.row_number().over(order) - 1).alias("seq"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        turns = self.table("conversations").where(F.col("role").isin("user", "assistant"))
        one = turns.groupBy("conv_id").agg(first_user_message("role", "text", "turn").alias("first"), F.max("turn").alias("last"), F.count("*").cast("int").alias("message_count"))
        ids = F.array(*[F.lit(s) for s in SOURCE_IDS])
        c = F.col("conv_id")
        return one.select(
            F.concat(F.lit("s"), c).alias("id"), F.element_at(ids, (c % len(SOURCE_IDS) + 1).cast("int")).alias("source"), F.concat(F.lit("conv-"), c).alias("source_id"), title("first").alias("title"),
            F.when(c % 11 != 0, F.concat(F.lit("/proj/"), (c % 5).cast("string"))).alias("directory"), self.started.alias("started_at"), F.when(c % 13 != 0, self.started + F.col("last") * 60_000).alias("updated_at"),
            "message_count", F.lit(None).cast("string").alias("entrypoint"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Vectors under message ids; some have no message, some messages have no vector."""
        n = self.table("conversations").agg(F.countDistinct("conv_id")).first()[0]
        v = F.col("vec_id")
        return self.table("embeddings").select(((v % n) * 100_000 + F.floor(v / n)).cast("bigint").alias("message_id"), "embedding")

    @cached_property
    def query_vector(self) -> list[float]:
        return self.table("embeddings").where(F.col("vec_id") == 0).first()["embedding"]


_SOURCES = ", ".join(f"'{s}'" for s in SOURCE_IDS)
_BLANK = r"^[\s\p{Z}]+"

#: The same views as a WITH clause.
SQL = rf"""WITH turns AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant')),
messages AS (
  SELECT conv_id * 100000 + turn AS message_id, 's' || conv_id AS session_id, role, text AS content,
         {AS_OF} - ((conv_id * 7919) % 1080) * 3600000 + turn * 60000 AS timestamp,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, conv_id, turn
  FROM turns),
firsts AS (
  SELECT conv_id, coalesce(
      arg_min(text, turn) FILTER (role = 'user' AND NOT (regexp_replace(text, '{_BLANK}', '') LIKE '<command-message>%'
        OR regexp_replace(text, '{_BLANK}', '') LIKE '<local-command-caveat>%' OR regexp_replace(text, '{_BLANK}', '') LIKE '# New session -%')),
      arg_min(text, turn) FILTER (role = 'user'), '') AS first, max(turn) AS last, count(*)::INT AS message_count
  FROM turns GROUP BY conv_id),
trimmed AS (SELECT *, regexp_replace(regexp_replace(first, '{_BLANK}', ''), '[\s\p{{Z}}]+$', '') AS t FROM firsts),
sessions AS (
  SELECT 's' || conv_id AS id, [{_SOURCES}][(conv_id % 7 + 1)::INT] AS source, 'conv-' || conv_id AS source_id,
         CASE WHEN t = '' THEN 'Untitled' WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS title,
         CASE WHEN conv_id % 11 <> 0 THEN '/proj/' || (conv_id % 5) END AS directory,
         {AS_OF} - ((conv_id * 7919) % 1080) * 3600000 AS started_at,
         CASE WHEN conv_id % 13 <> 0 THEN {AS_OF} - ((conv_id * 7919) % 1080) * 3600000 + last * 60000 END AS updated_at,
         message_count
  FROM trimmed),
vectors AS (
  SELECT (vec_id % n) * 100000 + vec_id // n AS message_id, embedding::DOUBLE[] AS embedding
  FROM embeddings, (SELECT count(DISTINCT conv_id) AS n FROM conversations))
"""
