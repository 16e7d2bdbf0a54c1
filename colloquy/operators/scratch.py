"""A folder for tables that one job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    root = named.get() if named.nonEmpty() else sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = tempfile.mkdtemp(prefix="stores-")
    return f"{root}/work-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it from there, so that nothing before it is computed again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that cut() has written for df; nothing that is still to be computed may read it."""
    jvm, at = df.sparkSession._jvm, df.inputFiles()
    if at:
        path = jvm.org.apache.hadoop.fs.Path(at[0]).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
