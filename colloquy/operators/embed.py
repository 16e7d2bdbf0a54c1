"""Embedding of messages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import embedding_text
from colloquy.operators.stats import pending_messages

DIMENSION, BATCH, MOST_TOKENS = 384, 8, 512
#: Texts whose vectors a worker holds at a time.
WRITTEN = 256


class HashedTerms:
    """Default encoder: signed term hashes of up to 512 words, unit length. Any callable from texts to a matrix may stand in its place."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in text.lower().split()[:MOST_TOKENS]:
                h = zlib.crc32(word.encode())
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def encode(texts: DataFrame, key: str, text: str, encoder: Callable[[list[str]], np.ndarray] | None = None, prefix: str = "passage: ", batch: int = BATCH) -> DataFrame:
    """(key, embedding, error) of each text; the encoder is set up once for each Python worker. A batch that fails is tried text by text; a text that fails has an error and no vector."""
    model, batch_size = encoder or HashedTerms(), batch
    kind = dict(texts.dtypes)[key]

    def tried(some: list[str]) -> tuple[list, list]:
        try:
            return list(np.asarray(model(some), np.float32)), [None] * len(some)
        except Exception as e:  # noqa: BLE001  the encoder is the caller's
            if len(some) == 1:
                return [None], [str(e)]
            one = [tried([t]) for t in some]
            return [v for x, _ in one for v in x], [e for _, x in one for e in x]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, WRITTEN):  # few vectors stand in memory, however many texts come at once
                part = batch.slice(i, WRITTEN)
                inputs = [prefix + (t or "") for t in part.column(1).to_pylist()]
                both = [tried(inputs[j : j + batch_size]) for j in range(0, len(inputs), batch_size)]
                vectors = pa.array([v for x, _ in both for v in x], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors, pa.array([e for _, x in both for e in x], pa.string())], names=[key, "embedding", "error"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>, error string")


def encode_query(query: str, encoder: Callable[[list[str]], np.ndarray] | None = None) -> list[float]:
    return [float(x) for x in np.asarray((encoder or HashedTerms())(["query: " + query]))[0]]


def embed_pending(sessions: DataFrame, messages: DataFrame, vectors: DataFrame, encoder: Callable[[list[str]], np.ndarray] | None = None, partitions: int | None = None) -> DataFrame:
    """(session_id, message_id, embedding, error) of all embeddable messages without a vector: a vector, or why there is none."""
    todo = pending_messages(messages, vectors).join(sessions.select(F.col("id").alias("session_id"), "title").hint("merge"), "session_id")
    texts = todo.select(F.struct("message_id", "session_id").alias("unit"), embedding_text("title", "content").alias("text"))
    done = encode(texts.repartition(partitions, "unit") if partitions else texts, "unit", "text", encoder)
    return done.select("unit.session_id", "unit.message_id", "embedding", "error")


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with the new ones in place of those of the same message."""
    return vectors.join(new.select("message_id").distinct(), "message_id", "left_anti").unionByName(new)
