"""Expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def literal_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def as_doubles(col: str | Column) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("array<double>")


def pack(columns) -> Column:
    """Wide numeric columns as one ``array<double>``."""
    return F.array(*[F.col(c).cast("double") for c in columns])
