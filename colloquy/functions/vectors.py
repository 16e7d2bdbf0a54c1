"""Vector expressions on array<float> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


def _double(c: str | Column) -> Column:
    return col(c).cast("array<double>")


def is_whole(v: str | Column, dimension: int) -> Column:
    """Whether a vector is there, of the dimension asked for, with every number."""
    return F.coalesce((F.size(col(v)) == dimension) & ~F.exists(col(v), lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def l2_squared(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(v: str | Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / norm))


def masked_mean(vectors: str | Column, mask: str | Column) -> Column:
    """Mean of the token vectors whose mask is 1; null where none is."""
    total = F.aggregate(col(mask), F.lit(0.0), lambda s, m: s + m.cast("double"))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v.cast("array<double>"), lambda x: x * m.cast("double")))
    zeros = F.transform(F.get(col(vectors), 0), lambda _: F.lit(0.0))
    summed = F.aggregate(weighted, zeros, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(total > 0, F.transform(summed, lambda x: x / total))


def mean_by(rows: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """(key, m): mean of a group's vectors whose mask is true, position by position; no row where none is.

    Partial sums are made where the rows are read, so a group may have any number of rows; ``masked_mean`` is for the tokens of one text."""
    numbers = rows.where(mask).select(key, F.posexplode(vector).alias("position", "x"))
    means = numbers.groupBy(key, "position").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # as many rows a group as a vector has numbers
    return means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "x"))).alias("m")).select(key, F.col("m.x").alias("m"))
