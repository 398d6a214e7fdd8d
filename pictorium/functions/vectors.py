"""Vector arithmetic on arrays of doubles, in higher-order functions of Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Similarity from precomputed norms; null for a zero vector."""
    return F.try_divide(dot(a, b), norm_a * norm_b)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b, norm(a), norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def pixel_scaled(a: Column) -> Column:
    """Pixel values to about -1..1."""
    return F.transform(a, lambda x: (x - 127.5) / 128)


def averaged(a: Column, b: Column) -> Column:
    """Mean of two probability vectors."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def arg_max(a: Column) -> Column:
    """Position (from 0) of the first largest element."""
    return F.array_position(a, F.array_max(a)) - 1


def standardised(a: Column, mean: Column, deviation: Column) -> Column:
    return F.zip_with(F.zip_with(a, mean, lambda x, m: x - m), deviation, lambda x, d: F.try_divide(x, d))
