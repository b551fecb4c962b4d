"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (norm(x) * norm(y))


def rms_distance(x: Column, y: Column) -> Column:
    """Root mean square difference of two signatures."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v) / F.size(x))


def normalised(x: Column) -> Column:
    n = norm(x)
    return F.transform(x, lambda v: (v / F.when(n > 0, n).otherwise(F.lit(1.0))).cast("float"))
