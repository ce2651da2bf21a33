"""Periods as plain column pairs: half-open [lo, hi), a NULL hi means still valid.

Two families of predicates stand side by side and must not be mixed: ranges
are half-open, boxes are closed on every side. Each returns a Column, so
Spark pushes the comparisons on lo and hi down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_current(hi: ColumnLike) -> Column:
    """Open-ended: valid until further notice."""
    return _c(hi).isNull()


def is_empty(lo: ColumnLike, hi: ColumnLike) -> Column:
    return F.coalesce(_c(hi) <= _c(lo), F.lit(False))


def ends_after(hi: ColumnLike, t: ColumnLike) -> Column:
    return _c(hi).isNull() | (_c(hi) > _c(t))


def range_overlaps(lo: ColumnLike, hi: ColumnLike, a: ColumnLike, b: ColumnLike | None) -> Column:
    """&& of half-open ranges, empty ones excluded; b None is unbounded."""
    upper = F.lit(True) if b is None else (_c(b).isNull() | (_c(lo) < _c(b)))
    return upper & ends_after(hi, a) & ~is_empty(lo, hi)


def range_contains_elem(lo: ColumnLike, hi: ColumnLike, t: ColumnLike) -> Column:
    """@> of a half-open range and a point."""
    return (_c(lo) <= _c(t)) & ends_after(hi, t)


def range_contains(lo: ColumnLike, hi: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    """[lo, hi) @> [a, b); an open-ended [a, NULL) fits only an open-ended range."""
    return (_c(lo) <= _c(a)) & (_c(hi).isNull() | (_c(b).isNotNull() & (_c(hi) >= _c(b))))


def range_contained_by(lo: ColumnLike, hi: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    return range_contains(a, b, lo, hi)


def range_before(hi: ColumnLike, a: ColumnLike) -> Column:
    """<<: ends before a starts."""
    return F.coalesce(_c(hi) <= _c(a), F.lit(False))


def range_after(lo: ColumnLike, b: ColumnLike) -> Column:
    return F.coalesce(_c(lo) >= _c(b), F.lit(False))


def range_adjacent(lo: ColumnLike, hi: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    return F.coalesce(_c(hi) == _c(a), F.lit(False)) | F.coalesce(_c(b) == _c(lo), F.lit(False))


def range_overleft(hi: ColumnLike, b: ColumnLike) -> Column:
    """&<: doesn't extend to the right of the other."""
    return _c(b).isNull() | F.coalesce(_c(hi) <= _c(b), F.lit(False))


def range_overright(lo: ColumnLike, a: ColumnLike) -> Column:
    return _c(lo) >= _c(a)


def box_overlaps(attr: ColumnLike, lo: ColumnLike, hi: ColumnLike, value: ColumnLike, t1: ColumnLike, t2: ColumnLike) -> Column:
    """Closed overlap of [attr] x [lo, hi] and [value] x [t1, t2]: touching counts."""
    return (_c(attr) == _c(value)) & (_c(lo) <= _c(t2)) & (_c(hi).isNull() | (_c(hi) >= _c(t1)))


def box_contains(attr: ColumnLike, lo: ColumnLike, hi: ColumnLike, value: ColumnLike, t1: ColumnLike, t2: ColumnLike) -> Column:
    return (_c(attr) == _c(value)) & (_c(lo) <= _c(t1)) & (_c(hi).isNull() | (_c(hi) >= _c(t2)))


def box_contained_by(attr: ColumnLike, lo: ColumnLike, hi: ColumnLike, value: ColumnLike, t1: ColumnLike, t2: ColumnLike) -> Column:
    """An open-ended row is never contained in a finite box."""
    return (_c(attr) == _c(value)) & (_c(lo) >= _c(t1)) & _c(hi).isNotNull() & (_c(hi) <= _c(t2))


#: Box predicates by operator.
BOX_OPERATORS: dict[str, Callable[..., Column]] = {"&&": box_overlaps, "@>": box_contains, "<@": box_contained_by}

ALLEN = ("before", "meets", "overlaps", "finished_by", "contains", "starts", "equals", "started_by", "during", "finishes", "overlapped_by", "met_by", "after")


def allen(lo1: ColumnLike, hi1: ColumnLike, lo2: ColumnLike, hi2: ColumnLike) -> Column:
    """The one of Allen's 13 relations that holds between two non-empty ranges; NULL hi is infinity."""
    a, b, c, d = _c(lo1), _c(hi1), _c(lo2), _c(hi2)
    same_end = b.eqNullSafe(d)
    ends_first = b.isNotNull() & (d.isNull() | (b < d))
    return (
        F.when(b < c, "before")
        .when(b == c, "meets")
        .when(a > d, "after")
        .when(a == d, "met_by")
        .when((a == c) & same_end, "equals")
        .when((a == c) & ends_first, "starts")
        .when(a == c, "started_by")
        .when(same_end & (a > c), "finishes")
        .when(same_end, "finished_by")
        .when((a > c) & ends_first, "during")
        .when((a < c) & ~ends_first, "contains")
        .when(a < c, "overlaps")
        .otherwise("overlapped_by")
    )
