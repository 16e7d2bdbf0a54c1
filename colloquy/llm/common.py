"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a function from batch to batch gets at once; bound a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the one the cluster names in spark.checkpoint.dir.

    Only where none is named and the session is local, as in tests, a temporary folder is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there; release() deletes it when nothing needs it any more."""
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Delete tables of cut_lineage whose readers have all been written themselves."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return texts.fill_null("").cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).to_pylist()


def portions(batch: pa.RecordBatch, most_bytes: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and about so many bytes; a row that is larger stands alone."""
    total, at = batch.num_rows, 0
    if total <= rows and batch.nbytes <= most_bytes:
        yield batch
        return
    while at < total:
        n = min(rows, total - at)
        while n > 1 and batch.slice(at, n).nbytes > most_bytes:
            n = -(-n // 2)
        yield batch.slice(at, n)
        at += n


def per_batch(df: DataFrame, columns: list, fn: Callable[[pa.RecordBatch], dict | None], schema: str, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow with a function from a portion of rows to the output's columns, in the order of schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in portions(batch, most_bytes):
                if some.num_rows and (out := fn(some)) is not None:
                    arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=f.type) for v, f in zip(out.values(), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def fold(doc_id: str, folds: int = 5):
    """Column: crc32 of the id's decimal text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from its concatenated values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def crc(data: bytes) -> int:
    return zlib.crc32(data)
