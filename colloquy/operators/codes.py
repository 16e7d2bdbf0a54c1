"""Vectors as product-quantised codes, searched by distance tables and re-ranked exactly.

A vector is written as its cell's centre plus a rest; the rest is cut into parts, each replaced by the number of the nearest entry in
that part's codebook, one byte a part. Cells and codebooks are fitted on a bounded sample; every vector is coded. A search looks numbers
up in tables of the query's products with all entries, keeps a few hundred ids a query, and measures only those by their full vectors.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.vectors import is_whole, l2
from colloquy.operators.search import BLOCK, comparable, dealt, meet, packed, row_by_row, smallest
from colloquy.operators.store import Store

#: Vectors that codebooks are fitted on, cells, bytes of a code, entries of a codebook, rounds of fitting.
SAMPLE, MOST_CELLS, PARTS, ENTRIES, ROUNDS = 20_000, 256, 32, 256, 10
#: Ids re-ranked for each neighbour wanted, at least, rows that a chunk of codes holds, and queries whose distances to a chunk stand in memory at once.
PER_NEIGHBOUR, CHUNK, MEASURED = 4, 16_384, 32

VECTORS = "message_id bigint, embedding array<float>, session_id string"
CODE_SCHEMA = "message_id bigint, cell int, code binary, bias float"


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means: centres that start at rows of x; one that loses all its rows stays where it is."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].astype(float)
    for _ in range(rounds):
        at = nearest_entry(x, centres)
        n = np.bincount(at, minlength=k)[:, None]
        total = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centres = np.where(n > 0, total / np.maximum(n, 1), centres)
    return centres


def nearest_entry(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return np.argmin((entries * entries).sum(1)[None, :] - 2 * x @ entries.T, axis=1)


@dataclass
class Codebooks:
    """Centres of cells, the numbers each part covers, and each part's entries (a row each; parts may have fewer than a byte tells apart)."""

    centres: np.ndarray
    edges: list[int]
    entries: list[np.ndarray]

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and bias of each row. Bias: what a squared distance holds besides the cell's part and the products with entries."""
        cell = nearest_entry(x, self.centres)
        rest = x - self.centres[cell]
        parts = list(zip(self.edges, self.edges[1:], self.entries, strict=False))
        code = np.stack([nearest_entry(rest[:, a:b], e) for a, b, e in parts], axis=1).astype(np.uint8)
        near = np.concatenate([e[code[:, m]] for m, (_, _, e) in enumerate(parts)], axis=1)
        return cell, code, (near * (near + 2 * self.centres[cell])).sum(1)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each query: squared distances to all cells' centres, and for each part twice its products with the part's entries."""
        cells = (q * q).sum(1)[:, None] - 2 * q @ self.centres.T + (self.centres * self.centres).sum(1)[None, :]
        return cells, [2 * q[:, a:b] @ e.T for a, b, e in zip(self.edges, self.edges[1:], self.entries, strict=False)]

    def far(self, tables: tuple[np.ndarray, list[np.ndarray]], cell: np.ndarray, code: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Squared distances of all queries to coded vectors, from tables alone."""
        cells, parts = tables
        out = cells[:, cell] + bias
        for m, products in enumerate(parts):
            out -= products[:, code[:, m]]
        return out


def fit(vectors: DataFrame, parts: int = PARTS, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Codebooks | None:
    """Codebooks from at most ``sample`` vectors (the smallest by a hash of their ids); None where no vector is whole. A cell for each 64 of them, unless told."""
    dimension = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = vectors.where(is_whole("embedding", dimension)).orderBy(F.xxhash64("message_id", F.lit(seed)), "message_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(rows) or not dimension:
        return None
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    centres = _centres(x, cells or max(1, min(MOST_CELLS, len(x) // 64)), seed)
    rest = x - centres[nearest_entry(x, centres)]
    edges = [round(i * dimension / min(parts, dimension)) for i in range(min(parts, dimension) + 1)]
    return Codebooks(centres, edges, [_centres(rest[:, a:b], ENTRIES, seed + a) for a, b in zip(edges, edges[1:], strict=False)])


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(message_id, cell, code, bias) of every whole vector: a byte a part and eight bytes beside, instead of four bytes a number."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                cell, code, bias = books.encode(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(bias, pa.float32())], names=["message_id", "cell", "code", "bias"])

    return vectors.where(is_whole("embedding", books.dimension)).select("message_id", "embedding").mapInArrow(run, CODE_SCHEMA)


def _chunks(codes: DataFrame) -> DataFrame:
    """Codes in rows of at most CHUNK each: ids, cells, codes and biases as bytes."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                some = batch.slice(i, CHUNK)
                ids, cells, bias = (some.column(n).to_numpy(zero_copy_only=False) for n in (0, 1, 3))
                parts = [ids.astype(np.int64).tobytes(), cells.astype(np.int32).tobytes(), b"".join(some.column(2).to_pylist()), bias.astype(np.float32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["ids", "cells", "codes", "bias"])

    return codes.mapInArrow(run, "ids binary, cells binary, codes binary, bias binary")


def shortlist(codes: DataFrame, queries: DataFrame, books: Codebooks, n: int) -> DataFrame:
    """(query_id, message_id): the n nearest of each query by coded distances, ties by id. Each task keeps n for each of its
    queries, so what is dealt out grows with the queries; blocks of queries meet chunks of codes in a join, neither passes through the driver."""

    def near(batches):
        held: dict = {}
        for asked, wanted, ids, cells, code, bias in row_by_row(batches):
            ids, wanted = np.frombuffer(ids, np.int64), np.frombuffer(wanted).reshape(len(asked) // 8, -1)
            cells, code, bias = np.frombuffer(cells, np.int32), np.frombuffer(code, np.uint8).reshape(len(ids), -1), np.frombuffer(bias, np.float32)
            take, found = min(n, len(ids)), []
            for i in range(0, len(wanted), MEASURED):  # distances of some queries at a time
                far = books.far(books.tables(wanted[i : i + MEASURED]), cells, code, bias)
                query, at = np.nonzero(far <= np.partition(far, take - 1, axis=1)[:, take - 1 : take])
                found.append(smallest(query + i, ids[at], far[query, at], n))
            if asked in held:
                found.append(held[asked])
            held[asked] = smallest(*(np.concatenate(x) for x in zip(*found, strict=True)), n)
        for asked, (query, ids, far) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(asked, np.int64)[query]), pa.array(ids), pa.array(far)], names=["query_id", "message_id", "far"])

    few, tasks = dealt(queries, BLOCK)
    pairs = meet(packed(few, "query_id", BLOCK, ("asked", "wanted")), _chunks(codes), tasks)
    local = pairs.select("asked", "wanted", "ids", "cells", "codes", "bias").mapInArrow(near, "query_id bigint, message_id bigint, far double")
    order = Window.partitionBy("query_id").orderBy("far", "message_id")
    return local.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select("query_id", "message_id")


def search_codes(codes: DataFrame, vectors: DataFrame, queries: DataFrame, books: Codebooks, k: int, rerank: int | None = None) -> DataFrame:
    """(query_id, message_id, distance): of each query's ``rerank`` nearest by codes the k nearest by their full vectors."""
    vectors, queries = comparable(vectors, queries)
    few = shortlist(codes, queries, books, rerank or PER_NEIGHBOUR * k)
    met = few.join(queries.withColumnRenamed("embedding", "q"), "query_id").join(vectors, "message_id")
    order = Window.partitionBy("query_id").orderBy("distance", "message_id")
    measured = met.select("query_id", "message_id", l2("q", "embedding").alias("distance"))
    return measured.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def approximate_neighbours(vectors: DataFrame, queries: DataFrame, k: int, rerank: int | None = None, **fitting) -> DataFrame:
    """The same from vectors alone: codebooks are fitted and every vector coded first. A store keeps both (code_vectors, search_store)."""
    books = fit(vectors, **fitting)
    if books is None:
        return vectors.select(F.col("message_id").alias("query_id"), "message_id", F.lit(0.0).alias("distance")).limit(0)
    return search_codes(encode(vectors, books), vectors, queries, books, k, rerank)


def share_found(exact: DataFrame, found: DataFrame, n_vectors: int, rerank: int) -> DataFrame:
    """One row: queries, pairs (true neighbours), found of them, their share, and the share of all full vectors that a query measures."""
    both = exact.select("query_id", "message_id").join(found.select("query_id", "message_id", F.lit(1).alias("is_found")), ["query_id", "message_id"], "left")
    share = F.when(F.count("*") == 0, 1.0).otherwise(F.count("is_found") / F.count("*"))
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("pairs"), F.count("is_found").alias("found"), share.alias("share_found"), F.lit(min(1.0, rerank / max(n_vectors, 1))).alias("share_read"))


# In a store

CODES = f"{CODE_SCHEMA}, session_id string"
BOOKS = "books binary"


def save_books(books: Codebooks) -> bytes:
    out = io.BytesIO()
    np.savez(out, centres=books.centres, edges=np.array(books.edges), **{f"e{i}": e for i, e in enumerate(books.entries)})
    return out.getvalue()


def load_books(data: bytes) -> Codebooks:
    held = np.load(io.BytesIO(data))
    return Codebooks(held["centres"], held["edges"].tolist(), [held[f"e{i}"] for i in range(len(held["edges"]) - 1)])


def stored_books(store: Store, manifest: dict) -> Codebooks | None:
    """The store's codebooks: one row, some hundred kilobytes."""
    row = store.read("codebooks", BOOKS, manifest).first()
    return load_books(row[0]) if row else None


def code_vectors(store: Store, **fitting) -> dict:
    """Codes for the store's vectors that have none yet; codebooks are fitted the first time and kept. Codes die with their session's vectors."""
    base = store.manifest()
    vectors = store.read("vectors", VECTORS, base)
    books = stored_books(store, base)
    new = {}
    if books is None:
        books = fit(vectors, **fitting)
        if books is None:
            return base
        new["codebooks"] = store.spark.createDataFrame([(bytearray(save_books(books)),)], BOOKS)
    left = vectors.join(store.read("codes", CODES, base).select("message_id"), "message_id", "left_anti")
    coded = encode(left, books).join(left.select("message_id", "session_id"), "message_id")
    buckets = set(base["tables"].get("vectors", {}))
    return store.append(new | {"codes": coded.select("message_id", "cell", "code", "bias", "session_id")}, base, touched=buckets)


def search_store(store: Store, queries: DataFrame, k: int, rerank: int | None = None) -> DataFrame:
    """search_codes over what code_vectors has coded."""
    manifest = store.manifest()
    books = stored_books(store, manifest)
    vectors = store.read("vectors", "message_id bigint, embedding array<float>", manifest)
    if books is None:
        return queries.select("query_id", F.lit(0).cast("bigint").alias("message_id"), F.lit(0.0).alias("distance")).limit(0)
    return search_codes(store.read("codes", CODE_SCHEMA, manifest), vectors, queries, books, k, rerank)
