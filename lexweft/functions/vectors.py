"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of different size."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different size or without length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def truncate(a: Column, dim: int) -> Column:
    return F.slice(a, 1, dim)


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def or_zeros(a: Column, dim: int) -> Column:
    """Zeros where an embedding failed."""
    return F.coalesce(a, F.array_repeat(F.lit(0.0).cast("float"), dim))
