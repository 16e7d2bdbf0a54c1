"""Typed access to JSON values: nothing is coerced, an explicit null is a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def parse(c: str | Column) -> Column:
    """The JSON value of a text; null where it is none."""
    return F.try_parse_json(col(c))


def get(v: Column, path: str) -> Column:
    """The value at a path; null only where the path is absent."""
    return F.try_variant_get(v, path, "variant")


def is_kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def string(v: Column, path: str | None = None) -> Column:
    """The string at a path; null for any other type."""
    x = get(v, path) if path else v
    return F.when(is_kind(x, "STRING"), F.try_variant_get(x, "$", "string"))


def integer(v: Column, path: str | None = None) -> Column:
    x = get(v, path) if path else v
    return F.when(is_kind(x, "BIGINT"), F.try_variant_get(x, "$", "bigint"))


def array(v: Column, path: str | None = None) -> Column:
    """The array at a path, as array<variant>; null for any other type."""
    x = get(v, path) if path else v
    return F.when(is_kind(x, "ARRAY"), F.try_variant_get(x, "$", "array<variant>"))


def text_of(v: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(v)


def valid(c: str | Column) -> Column:
    return F.coalesce(parse(c).isNotNull(), F.lit(False))


def present(v: Column, path: str) -> Column:
    return get(v, path).isNotNull()
