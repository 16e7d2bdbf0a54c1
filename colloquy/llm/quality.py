"""Quality classifier: a byte-level convolutional network in numpy.

The whole text is cut into overlapping chunks of ``2 * STEP`` bytes, one every ``STEP`` bytes. Byte embeddings and learned filters
give each chunk its activations; the largest activation of each filter over the whole document, and the largest mean over
overlapping stretches of chunks, go through one logistic unit to one probability.

The network learns from a bounded sample of labelled rows (``SAMPLE`` for each label, by hash of the id; whole texts of at most
``LONGEST`` bytes, so that what reaches the driver is bounded too), by Adam with balanced labels. Labels, language, source and id are
never inputs of a score. Texts of any length are scored whole.

Null and empty texts are scored as a text of padding alone. A training set without both labels, as any that is empty, gives the neutral
score 0.5 to all texts; an empty table gives no rows. Repeated rows each get their score; equal texts get equal scores. Where an id has
several labels, one of them counts; ties in the sample's order go to the smaller id. Columns of any name pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fold, per_batch, read_table

STEP, EMBED, FILTERS, STRETCH = 4, 8, 24, 32
#: Labelled rows of each label that the network learns from, at most.
SAMPLE = 1200
#: Bytes of a text that it learns from, at most.
LONGEST = 1 << 17
EPOCHS, BATCH, RATE = 14, 24, 0.006
THRESHOLD = 0.3


class Network:
    """Weights of the network; float32 arrays throughout."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (257, EMBED)),
            "filter": r.normal(0, (2 / (2 * STEP * EMBED)) ** 0.5, (2 * STEP * EMBED, FILTERS)),
            "shift": np.zeros(FILTERS),
            "out": r.normal(0, 0.1, 2 * FILTERS),
            "bias": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.neutral = False

    def _chunks(self, data: bytes) -> np.ndarray:
        """Byte ids in rows of STEP, padded by 256; at least two rows."""
        n = max(2, -(-len(data) // STEP))
        ids = np.full(n * STEP, 256, np.int64)
        ids[: len(data)] = np.frombuffer(data, np.uint8)
        return ids.reshape(n, STEP)

    def _activate(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.w["embed"][ids].reshape(len(ids), STEP * EMBED)
        half = STEP * EMBED
        return rows, np.maximum(rows[:-1] @ self.w["filter"][:half] + rows[1:] @ self.w["filter"][half:] + self.w["shift"], 0)

    @staticmethod
    def _stretches(act: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean activation of overlapping stretches, each starting half a stretch after the one before; their edges."""
        half = STRETCH // 2
        start = np.arange(0, max(1, len(act) - half), half)
        end = np.minimum(start + STRETCH, len(act))
        total = np.add.reduceat(act, np.arange(0, len(act), half), axis=0)
        both = total.copy()
        both[:-1] += total[1:]
        both = both[: len(start)]
        return both / (end - start)[:, None].astype(np.float32), np.stack([start, end], 1)

    def pooled(self, data: bytes) -> np.ndarray:
        _, act = self._activate(self._chunks(data))
        return np.concatenate([act.max(0), self._stretches(act)[0].max(0)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.neutral:
            return np.full(len(texts), 0.5)
        x = np.stack([self.pooled(t) for t in texts]) if texts else np.zeros((0, 2 * FILTERS))
        # summed row by row, so that equal texts score equally in any batch
        return 1 / (1 + np.exp(-((x.astype(float) * self.w["out"]).sum(1) + float(self.w["bias"][0]))))

    def _gradients(self, data: bytes, label: float, weight: float, grads: dict[str, np.ndarray]) -> None:
        ids = self._chunks(data)
        rows, act = self._activate(ids)
        mean, edges = self._stretches(act)
        top, best = act.argmax(0), mean.argmax(0)
        cols = np.arange(FILTERS)
        x = np.concatenate([act[top, cols], mean[best, cols]])
        p = 1 / (1 + np.exp(-float(x @ self.w["out"] + self.w["bias"][0])))
        g = np.float32((p - label) * weight)
        grads["out"] += g * x
        grads["bias"] += g
        back = g * self.w["out"]
        # only chunks that a maximum chose carry a gradient
        at = np.concatenate([top, *[np.arange(*edges[b]) for b in best]])
        size = np.array([edges[b][1] - edges[b][0] for b in best])
        col = np.concatenate([cols, np.repeat(cols, size)])
        value = np.concatenate([back[:FILTERS], np.repeat(back[FILTERS:] / size, size)])
        value = np.where(act[at, col] > 0, value, 0).astype(np.float32)
        used, where = np.unique(at, return_inverse=True)
        d = np.zeros((len(used), FILTERS), np.float32)
        np.add.at(d, (where, col), value)
        pair = np.concatenate([rows[used], rows[used + 1]], 1)
        grads["filter"] += pair.T @ d
        grads["shift"] += d.sum(0)
        dx = (d @ self.w["filter"].T).reshape(-1, EMBED)
        chosen = np.concatenate([ids[used], ids[used + 1]], 1).ravel()
        for e in range(EMBED):
            grads["embed"][:, e] += np.bincount(chosen, weights=dx[:, e], minlength=257)

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Network:
        y = np.array(labels, float)
        if len(set(labels)) < 2:
            self.neutral = True
            return self
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        steps, total = 0, max(1, epochs * -(-len(y) // BATCH))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                grads = {k: np.zeros(v.shape, np.float32) for k, v in self.w.items()}
                for j in some:
                    self._gradients(texts[j], y[j], weight[j] / len(some), grads)
                steps += 1
                rate = RATE * (1 - steps / (total + 1))
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
        return self


def sample(docs: DataFrame, labels: DataFrame, held_out: int | None, key: str = "doc_id", text: str = "text", label: str = "quality", size: int = SAMPLE) -> list[tuple[bytes, int]]:
    """At most size labelled texts of each label, by hash of the id, outside the held-out fold."""
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    if held_out is not None:
        named = named.where(fold("key") != held_out)
    order = F.xxhash64("key", F.lit("sample"))
    chosen = None
    for value in (0, 1):
        some = named.where(F.col("label") == value).dropDuplicates(["key"]).orderBy(order, "key").limit(size)
        chosen = some if chosen is None else chosen.unionAll(some)
    # at most 2 * size ids, whatever the input's size
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(chosen), "key").orderBy(order, "key", "text").limit(2 * size).collect()
    return [((r["text"] or "").encode(), r["label"]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, held_out: int | None = 0, **names) -> Network:
    rows = sample(docs, labels, held_out, **names)
    return Network().fit([t for t, _ in rows], [y for _, y in rows])


def classify(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) and the carried columns of every row."""
    carry = carry or []
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        score = network.score(as_bytes(batch.column(1)))
        return {"key": batch.column(0), "score": score, "predicted": (score >= threshold).astype(np.int32), **{str(i): batch.column(2 + i) for i in range(len(carry))}}

    schema = ", ".join([f"`{key}` {kinds[key]}", "score double", "predicted int", *[f"`_{c}` {kinds[c]}" for c in carry]])
    return per_batch(docs, [key, text, *carry], run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from the labels outside fold 0."""
    docs = read_table(spark, sf_dir, "documents")
    scored = classify(docs, train(docs, read_table(spark, sf_dir, "labels"), held_out=0))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_rejected(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose text the network doesn't reject, with all their columns."""
    names = [c for c in docs.columns if c not in (key, text)]
    kept = classify(docs, network, key, text, carry=[text, *names]).where(F.col("predicted") == 1)
    return kept.select(*[F.col(key) if c == key else F.col(f"_{c}").alias(c) for c in docs.columns])
