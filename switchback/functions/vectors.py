"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either side or an element is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a vector of length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalise(v: Column) -> Column:
    """The vector at unit length; null elements for a vector of length zero."""
    n = F.nullif(norm(v), F.lit(0.0))
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot; both must have unit length."""
    return F.lit(1.0) - dot(a, b)
