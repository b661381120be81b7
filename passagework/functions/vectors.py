"""Vector functions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector over its norm; null for a zero vector, which callers report."""
    n = l2_norm(v)
    # Repeated, the norm is computed once a vector; within a transform it would be once a component.
    return F.when(n > 0, F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, m: x.cast("double") / m))


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - (F.lit(1.0) - dot(l2_normalize(a), l2_normalize(b)))
