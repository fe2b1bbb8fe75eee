"""Vectors as arrays of numbers; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def truncated(a: Column, dim: int) -> Column:
    """The first ``dim`` components, normalised to unit length; a vector of zeros stays as it is."""
    head = F.slice(a, 1, dim)
    size = norm(head)
    return F.transform(head, lambda v: F.when(size > 0, v.cast("double") / size).otherwise(F.lit(0.0)))


def mean_pooled(states: Column, mask: Column) -> Column:
    """Mean of the vectors of an array<array<double>> where ``mask`` is 1; the divisor is at least 1e-9."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    weighted = F.zip_with(states, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    zero = F.transform(F.element_at(states, 1), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), lambda x: x / total)
