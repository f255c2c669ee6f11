"""Array expressions on ``array<double>`` columns that Spark has no built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Null where either vector is zero."""
    return dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0))


def sqdist(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def logsumexp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def tanimoto(x: Column, y: Column) -> Column:
    """Shared over all members of two sets given as arrays; null if both are empty."""
    both = F.size(F.array_intersect(x, y))
    return both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0))
