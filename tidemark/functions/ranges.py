"""Ranges with bounds of either kind, multiranges, boxes of n dimensions and plane geometry.

A range is struct(lo, hi, lo_inc, hi_inc, empty), null bounds being infinite;
a multirange is a sorted array of disjoint half-open struct(lo, hi); a box is
struct(ll array<double>, ur array<double>).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_range(lo: Column, hi: Column, bounds: str = "[)", discrete: Column | None = None) -> Column:
    """A range; with `discrete` (the step of its type) in canonical form [)."""
    lo_inc, hi_inc = F.lit(bounds[0] == "["), F.lit(bounds[1] == "]")
    if discrete is not None:
        lo = lo if bounds[0] == "[" else lo + discrete
        hi = hi + discrete if bounds[1] == "]" else hi
        lo_inc, hi_inc = F.lit(True), F.lit(False)
    empty = F.coalesce((lo > hi) | ((lo == hi) & ~(lo_inc & hi_inc)), F.lit(False))
    return F.struct(F.when(~empty, lo).alias("lo"), F.when(~empty, hi).alias("hi"), (lo_inc & lo.isNotNull() & ~empty).alias("lo_inc"), (hi_inc & hi.isNotNull() & ~empty).alias("hi_inc"), empty.alias("empty"))


def contains_elem(r: Column, x: Column) -> Column:
    low = r.lo.isNull() | (r.lo < x) | ((r.lo == x) & r.lo_inc)
    high = r.hi.isNull() | (r.hi > x) | ((r.hi == x) & r.hi_inc)
    return ~r.empty & low & high


def overlaps(a: Column, b: Column) -> Column:
    def reaches(x: Column, y: Column) -> Column:
        return x.lo.isNull() | y.hi.isNull() | (x.lo < y.hi) | ((x.lo == y.hi) & x.lo_inc & y.hi_inc)

    return ~a.empty & ~b.empty & reaches(a, b) & reaches(b, a)


def strictly_left(a: Column, b: Column) -> Column:
    return ~a.empty & ~b.empty & F.coalesce((a.hi < b.lo) | ((a.hi == b.lo) & ~(a.hi_inc & b.lo_inc)), F.lit(False))


def adjacent(a: Column, b: Column) -> Column:
    touch = lambda x, y: F.coalesce((x.hi == y.lo) & (x.hi_inc != y.lo_inc), F.lit(False))
    return ~a.empty & ~b.empty & (touch(a, b) | touch(b, a))


def multirange(periods: Column) -> Column:
    """Normalise an array of struct(lo, hi): sorted, overlapping and touching members joined."""
    kept = F.array_sort(F.filter(periods, lambda p: p.lo < p.hi))
    empty = F.slice(kept, 1, 0)

    def join(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last.lo.alias("lo"), F.greatest(last.hi, p.hi).alias("hi"))))
        return F.when(F.size(acc) == 0, F.array(p)).when(p.lo <= F.try_element_at(acc, F.lit(-1)).hi, grown).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(kept, empty, join)


def multirange_contains(m: Column, x: Column) -> Column:
    return F.exists(m, lambda p: (p.lo <= x) & (x < p.hi))


def multirange_intersect(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.struct(F.greatest(p.lo, q.lo).alias("lo"), F.least(p.hi, q.hi).alias("hi")))))
    return multirange(pairs)


def multirange_span(m: Column) -> Column:
    """Total length of the members."""
    return F.aggregate(m, F.lit(0).cast("double"), lambda acc, p: acc + (p.hi - p.lo))


def box(ll: Column, ur: Column) -> Column:
    """Corners in any order."""
    return F.struct(F.zip_with(ll, ur, lambda p, q: F.least(p, q)).alias("ll"), F.zip_with(ll, ur, lambda p, q: F.greatest(p, q)).alias("ur"))


def box_overlaps(a: Column, b: Column) -> Column:
    below = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: p <= q), lambda t: t)
    return below(a.ll, b.ur) & below(b.ll, a.ur)


def box_contains(a: Column, b: Column) -> Column:
    below = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: p <= q), lambda t: t)
    return below(a.ll, b.ll) & below(b.ur, a.ur)


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.zip_with(a.ll, b.ll, lambda p, q: F.least(p, q)).alias("ll"), F.zip_with(a.ur, b.ur, lambda p, q: F.greatest(p, q)).alias("ur"))


def box_inter(a: Column, b: Column) -> Column:
    return F.struct(F.zip_with(a.ll, b.ll, lambda p, q: F.greatest(p, q)).alias("ll"), F.zip_with(a.ur, b.ur, lambda p, q: F.least(p, q)).alias("ur"))


def box_size(a: Column) -> Column:
    return F.aggregate(F.zip_with(a.ur, a.ll, lambda p, q: p - q), F.lit(1.0), lambda acc, x: acc * x)


def _gaps(a: Column, b: Column) -> Column:
    one = F.zip_with(a.ll, b.ur, lambda p, q: p - q)
    two = F.zip_with(b.ll, a.ur, lambda p, q: p - q)
    return F.zip_with(one, two, lambda p, q: F.greatest(p, q, F.lit(0.0)))


def box_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(_gaps(a, b), F.lit(0.0), lambda acc, x: acc + x * x))


def box_taxicab(a: Column, b: Column) -> Column:
    return F.aggregate(_gaps(a, b), F.lit(0.0), lambda acc, x: acc + x)


def box_chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_gaps(a, b))


def box_enlarge(a: Column, r: float) -> Column:
    """Grow or shrink by r on every side; a side shrunk past its middle becomes its middle."""
    mid = F.zip_with(a.ll, a.ur, lambda p, q: (p + q) / 2)
    low = F.zip_with(F.transform(a.ll, lambda x: x - r), mid, lambda p, q: F.least(p, q))
    high = F.zip_with(F.transform(a.ur, lambda x: x + r), mid, lambda p, q: F.greatest(p, q))
    return F.struct(low.alias("ll"), high.alias("ur"))


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def polygon_area(points: Column) -> Column:
    """Shoelace area of array<struct(x, y)>."""
    n = F.size(points)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(points, i).x * F.get(points, (i + 1) % n).y - F.get(points, (i + 1) % n).x * F.get(points, i).y)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, x: acc + x)) / 2


def polygon_contains(points: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    n = F.size(points)

    def crosses(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, (i + 1) % n)
        return ((p.y > y) != (q.y > y)) & (x < (q.x - p.x) * (y - p.y) / F.nullif(q.y - p.y, F.lit(0.0)) + p.x)

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


EARTH_RADIUS = 6378168.0


def earth_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon1 - lon2) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


# Further accessors and operators of ranges.
def lower_inf(r: Column) -> Column:
    return ~r.empty & r.lo.isNull()


def upper_inf(r: Column) -> Column:
    return ~r.empty & r.hi.isNull()


def _starts(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a's lower bound comes before, with or after b's."""
    same = a.lo.eqNullSafe(b.lo) & (a.lo.isNull() | (a.lo_inc == b.lo_inc))
    before = (a.lo.isNull() & b.lo.isNotNull()) | (a.lo < b.lo) | ((a.lo == b.lo) & a.lo_inc & ~b.lo_inc)
    return F.when(same, 0).when(F.coalesce(before, F.lit(False)), -1).otherwise(1)


def _ends(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a's upper bound comes before, with or after b's."""
    same = a.hi.eqNullSafe(b.hi) & (a.hi.isNull() | (a.hi_inc == b.hi_inc))
    after = (a.hi.isNull() & b.hi.isNotNull()) | (a.hi > b.hi) | ((a.hi == b.hi) & a.hi_inc & ~b.hi_inc)
    return F.when(same, 0).when(F.coalesce(after, F.lit(False)), 1).otherwise(-1)


def contains_range(a: Column, b: Column) -> Column:
    """@> : an empty range is in every one."""
    return b.empty | (~a.empty & (_starts(a, b) <= 0) & (_ends(a, b) >= 0))


def range_cmp(a: Column, b: Column) -> Column:
    """Ordering: empty first, then by lower and by upper bound."""
    by_bounds = F.when(_starts(a, b) != 0, _starts(a, b)).otherwise(_ends(a, b))
    return F.when(a.empty & b.empty, 0).when(a.empty, -1).when(b.empty, 1).otherwise(by_bounds)


def overleft(a: Column, b: Column) -> Column:
    return ~a.empty & ~b.empty & (_ends(a, b) <= 0)


def overright(a: Column, b: Column) -> Column:
    return ~a.empty & ~b.empty & (_starts(a, b) >= 0)


def _spanning(a: Column, b: Column) -> Column:
    low, high = F.when(_starts(a, b) <= 0, a).otherwise(b), F.when(_ends(a, b) >= 0, a).otherwise(b)
    return F.struct(low.lo.alias("lo"), high.hi.alias("hi"), low.lo_inc.alias("lo_inc"), high.hi_inc.alias("hi_inc"), F.lit(False).alias("empty"))


def union(a: Column, b: Column) -> Column:
    """+ : an error where the result would have a gap."""
    joined = F.when(overlaps(a, b) | adjacent(a, b), _spanning(a, b)).otherwise(F.raise_error(F.lit("result of range union would not be contiguous")))
    return F.when(a.empty, b).when(b.empty, a).otherwise(joined)


def minus(a: Column, b: Column) -> Column:
    """- : an error where the result would be two ranges."""
    left = F.struct(a.lo.alias("lo"), b.lo.alias("hi"), a.lo_inc.alias("lo_inc"), (~b.lo_inc).alias("hi_inc"), F.lit(False).alias("empty"))
    right = F.struct(b.hi.alias("lo"), a.hi.alias("hi"), (~b.hi_inc).alias("lo_inc"), a.hi_inc.alias("hi_inc"), F.lit(False).alias("empty"))
    nothing = F.struct(F.nullif(a.lo, a.lo).alias("lo"), F.nullif(a.hi, a.hi).alias("hi"), F.lit(False).alias("lo_inc"), F.lit(False).alias("hi_inc"), F.lit(True).alias("empty"))
    split = (_starts(a, b) < 0) & (_ends(a, b) > 0)
    apart = F.when(split, F.raise_error(F.lit("result of range difference would not be contiguous"))).when(contains_range(b, a), nothing).when(_starts(a, b) < 0, left).otherwise(right)
    return F.when(~overlaps(a, b), a).otherwise(apart)


# Multiranges: sorted arrays of disjoint half-open struct(lo, hi).
def multirange_union(a: Column, b: Column) -> Column:
    return multirange(F.concat(a, b))


def multirange_minus(a: Column, b: Column) -> Column:
    """Each member of a, cut by every member of b."""
    part = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def cut(left: Column, q: Column) -> Column:
        pieces = F.flatten(F.transform(left, lambda p: F.array(part(p.lo, F.least(p.hi, q.lo)), part(F.greatest(p.lo, q.hi), p.hi))))
        return F.filter(pieces, lambda p: p.lo < p.hi)

    return F.aggregate(b, a, cut)


def multirange_overlaps(a: Column, b: Column) -> Column:
    return F.exists(a, lambda p: F.exists(b, lambda q: (p.lo < q.hi) & (q.lo < p.hi)))


def multirange_contains_all(a: Column, b: Column) -> Column:
    """@> of multiranges: each member of b lies in one of a."""
    return F.forall(b, lambda q: F.exists(a, lambda p: (p.lo <= q.lo) & (q.hi <= p.hi)))


def _ends_of(m: Column) -> tuple[Column, Column]:
    return F.try_element_at(m, F.lit(1)).lo, F.try_element_at(m, F.lit(-1)).hi


def multirange_before(a: Column, b: Column) -> Column:
    return F.coalesce(_ends_of(a)[1] <= _ends_of(b)[0], F.lit(False))


def multirange_after(a: Column, b: Column) -> Column:
    return multirange_before(b, a)


def multirange_overleft(a: Column, b: Column) -> Column:
    return F.coalesce(_ends_of(a)[1] <= _ends_of(b)[1], F.lit(False))


def multirange_overright(a: Column, b: Column) -> Column:
    return F.coalesce(_ends_of(a)[0] >= _ends_of(b)[0], F.lit(False))


def multirange_adjacent(a: Column, b: Column) -> Column:
    return F.coalesce((_ends_of(a)[1] == _ends_of(b)[0]) | (_ends_of(b)[1] == _ends_of(a)[0]), F.lit(False))


def unnest_multirange(m: Column) -> Column:
    """A row per member, to be selected."""
    return F.explode(m)


# Boxes of n dimensions: comparison, coordinates, points.
def box_is_point(a: Column) -> Column:
    return a.ll == a.ur


def box_contained(a: Column, b: Column) -> Column:
    return box_contains(b, a)


def box_dim(a: Column) -> Column:
    return F.size(a.ll)


def box_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by lower corners, then upper corners, then dimensions."""
    n = F.greatest(F.size(a.ll), F.size(b.ll))
    wide = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(x, i), F.lit(0.0)))
    one, two = F.concat(wide(a.ll), wide(a.ur)), F.concat(wide(b.ll), wide(b.ur))
    first = F.filter(F.zip_with(one, two, lambda p, q: F.signum(p - q)), lambda s: s != 0)
    return F.coalesce(F.get(first, F.lit(0)), F.signum(F.size(a.ll) - F.size(b.ll)).cast("double")).cast("int")


def box_lower(a: Column, i: int) -> Column:
    """The ith coordinate of the lower corner, from 1; 0 beyond the dimensions."""
    return F.coalesce(F.get(a.ll, F.lit(i - 1)), F.lit(0.0))


def box_upper(a: Column, i: int) -> Column:
    return F.coalesce(F.get(a.ur, F.lit(i - 1)), F.lit(0.0))


def box_coordinate(a: Column, i: int) -> Column:
    """-> : coordinates counted through both corners, from 1."""
    return F.element_at(F.concat(a.ll, a.ur), i)


def box_sort_coordinate(a: Column, i: int) -> Column:
    """~> : 2d - 1 is the lower and 2d the upper bound of dimension d; negative numbers change the sign."""
    d = (abs(i) + 1) // 2
    value = box_lower(a, d) if abs(i) % 2 else box_upper(a, d)
    return value if i > 0 else -value


def box_subset(a: Column, dims: list[int]) -> Column:
    return F.struct(F.array(*[F.element_at(a.ll, d) for d in dims]).alias("ll"), F.array(*[F.element_at(a.ur, d) for d in dims]).alias("ur"))


def box_with_dim(a: Column, low: Column, high: Column | None = None) -> Column:
    """cube(cube, x[, y]): one dimension more."""
    high = low if high is None else high
    return F.struct(F.concat(a.ll, F.array(low)).alias("ll"), F.concat(a.ur, F.array(high)).alias("ur"))
