"""Vector columns: distances between arrays of numbers, in double precision.

Vectors of different lengths, null ones and those with null components have a null distance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(a: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    return F.coalesce((F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """Cosine; null if either vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def distance(a: Column, b: Column, metric: str) -> Column:
    """A zero vector is at cosine distance 1 from every other."""
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if metric == "cosine":
        both = norm(a) * norm(b)
        return F.when(both > 0, 1 - dot(a, b) / both).when(both == 0, 1.0)
    if metric == "l1":
        return _sum(gap)
    if metric == "l2":
        return F.sqrt(_sum(F.transform(gap, lambda x: x * x)))
    if metric == "linf":
        return F.array_max(gap)
    raise ValueError(f"unknown metric: {metric}")
