"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(a: Column) -> Column:
    return a.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0; the product runs over the shorter length, the norms over all."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, as index files report it."""
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))) * (F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))))


def has_vector(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0)
