"""Integer array helpers, dimensions and builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def icount(a: Column) -> Column:
    return F.size(a)


def uniq(a: Column) -> Column:
    """Adjacent repeats removed."""
    kept = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
    return F.when(F.size(a) == 0, a).otherwise(F.transform(kept, lambda i: F.get(a, i)))


def idx(a: Column, x: int) -> Column:
    return F.array_position(a, x).cast("int")


def subarray(a: Column, start: int, n: int) -> Column:
    """1-based; a negative start counts from the end."""
    begin = F.lit(start) if start > 0 else F.greatest(F.size(a) + start + 1, F.lit(1))
    return F.slice(a, begin, F.lit(n))


def minus(a: Column, b: Column) -> Column:
    """Set difference, sorted."""
    return F.array_sort(F.array_except(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def dims(a: Column) -> Column:
    """[1:n]"""
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def trim_array(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - n, F.lit(0)))


def subscripts(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))


def positions(a: Column, x: Column) -> Column:
    """array_positions."""
    return F.filter(subscripts(a), lambda i: F.get(a, i - 1).eqNullSafe(x))


def replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda v: F.when(v.eqNullSafe(old), new).otherwise(v))


def larger_than_all(x: Column, a: Column) -> Column:
    """x > ALL(a)."""
    return F.forall(a, lambda v: x > v)
