"""Plane geometry: points, segments, lines, rectangles, paths, polygons and circles, as columns.

point struct(x, y); segment struct(p, q) of points; line struct(a, b, c) with
ax + by + c = 0; rectangle struct(hi, lo) of points; path struct(points, closed);
polygon array of points; circle struct(center, radius). Comparisons allow for
EPSILON, as coordinates are floating point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def _zero(x: Column) -> Column:
    return F.abs(x) <= EPSILON


# Points.
def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def same_point(a: Column, b: Column) -> Column:
    return _zero(a.x - b.x) & _zero(a.y - b.y)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a.x - b.x, a.y - b.y)


def add(a: Column, b: Column) -> Column:
    return point(a.x + b.x, a.y + b.y)


def subtract(a: Column, b: Column) -> Column:
    return point(a.x - b.x, a.y - b.y)


def multiply(a: Column, b: Column) -> Column:
    """As complex numbers: scales and turns."""
    return point(a.x * b.x - a.y * b.y, a.x * b.y + a.y * b.x)


def divide(a: Column, b: Column) -> Column:
    n = b.x * b.x + b.y * b.y
    return point((a.x * b.x + a.y * b.y) / n, (a.y * b.x - a.x * b.y) / n)


def is_left(a: Column, b: Column) -> Column:
    return a.x < b.x - EPSILON


def is_below(a: Column, b: Column) -> Column:
    return a.y < b.y - EPSILON


def slope(a: Column, b: Column) -> Column:
    """Infinite for points above each other."""
    return F.when(_zero(a.x - b.x), F.lit(float("inf"))).otherwise((a.y - b.y) / F.nullif(a.x - b.x, F.lit(0.0)))


# Segments.
def segment(p: Column, q: Column) -> Column:
    return F.struct(p.alias("p"), q.alias("q"))


def length(s: Column) -> Column:
    return distance(s.p, s.q)


def midpoint(s: Column) -> Column:
    return point((s.p.x + s.q.x) / 2, (s.p.y + s.q.y) / 2)


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a.x - o.x) * (b.y - o.y) - (a.y - o.y) * (b.x - o.x)


def is_horizontal(s: Column) -> Column:
    return _zero(s.p.y - s.q.y)


def is_vertical(s: Column) -> Column:
    return _zero(s.p.x - s.q.x)


def is_parallel(s: Column, t: Column) -> Column:
    return _zero((s.q.x - s.p.x) * (t.q.y - t.p.y) - (s.q.y - s.p.y) * (t.q.x - t.p.x))


def is_perpendicular(s: Column, t: Column) -> Column:
    return _zero((s.q.x - s.p.x) * (t.q.x - t.p.x) + (s.q.y - s.p.y) * (t.q.y - t.p.y))


def closest_on_segment(s: Column, a: Column) -> Column:
    dx, dy = s.q.x - s.p.x, s.q.y - s.p.y
    along = ((a.x - s.p.x) * dx + (a.y - s.p.y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along, F.lit(0.0))))
    return point(s.p.x + along * dx, s.p.y + along * dy)


def point_to_segment(a: Column, s: Column) -> Column:
    return distance(a, closest_on_segment(s, a))


def on_segment(a: Column, s: Column) -> Column:
    return _zero(distance(a, s.p) + distance(a, s.q) - length(s))


def segments_intersect(s: Column, t: Column) -> Column:
    """Ends that touch count."""
    side = lambda u, a: F.signum(F.when(_zero(_cross(u.p, u.q, a)), 0.0).otherwise(_cross(u.p, u.q, a)))
    crossing = (side(s, t.p) * side(s, t.q) < 0) & (side(t, s.p) * side(t, s.q) < 0)
    return crossing | on_segment(s.p, t) | on_segment(s.q, t) | on_segment(t.p, s) | on_segment(t.q, s)


def segment_distance(s: Column, t: Column) -> Column:
    apart = F.least(point_to_segment(s.p, t), point_to_segment(s.q, t), point_to_segment(t.p, s), point_to_segment(t.q, s))
    return F.when(segments_intersect(s, t), 0.0).otherwise(apart)


# Lines.
def line(p: Column, q: Column) -> Column:
    """Through two points; vertical ones have a = -1 and b = 0, others b = -1."""
    m = (q.y - p.y) / F.nullif(q.x - p.x, F.lit(0.0))
    upright = _zero(p.x - q.x)
    return F.struct(F.when(upright, -1.0).otherwise(m).alias("a"), F.when(upright, 0.0).otherwise(-1.0).alias("b"), F.when(upright, p.x).otherwise(p.y - m * p.x).alias("c"))


def point_to_line(a: Column, u: Column) -> Column:
    return F.abs(u.a * a.x + u.b * a.y + u.c) / F.hypot(u.a, u.b)


def lines_parallel(u: Column, v: Column) -> Column:
    return _zero(u.a * v.b - v.a * u.b)


def lines_perpendicular(u: Column, v: Column) -> Column:
    return _zero(u.a * v.a + u.b * v.b)


def lines_meet(u: Column, v: Column) -> Column:
    """Their common point; null for parallel lines."""
    d = u.a * v.b - v.a * u.b
    d = F.when(~_zero(d), d)
    return F.when(d.isNotNull(), point((u.b * v.c - v.b * u.c) / d, (v.a * u.c - u.a * v.c) / d))


# Rectangles.
def rectangle(p: Column, q: Column) -> Column:
    """Any two opposite corners."""
    return F.struct(point(F.greatest(p.x, q.x), F.greatest(p.y, q.y)).alias("hi"), point(F.least(p.x, q.x), F.least(p.y, q.y)).alias("lo"))


def width(r: Column) -> Column:
    return r.hi.x - r.lo.x


def height(r: Column) -> Column:
    return r.hi.y - r.lo.y


def area(r: Column) -> Column:
    return width(r) * height(r)


def center(r: Column) -> Column:
    return point((r.hi.x + r.lo.x) / 2, (r.hi.y + r.lo.y) / 2)


def diagonal(r: Column) -> Column:
    return segment(r.hi, r.lo)


def rectangles_overlap(r: Column, t: Column) -> Column:
    return (r.lo.x <= t.hi.x + EPSILON) & (t.lo.x <= r.hi.x + EPSILON) & (r.lo.y <= t.hi.y + EPSILON) & (t.lo.y <= r.hi.y + EPSILON)


def rectangle_contains(r: Column, t: Column) -> Column:
    return (r.lo.x <= t.lo.x + EPSILON) & (t.hi.x <= r.hi.x + EPSILON) & (r.lo.y <= t.lo.y + EPSILON) & (t.hi.y <= r.hi.y + EPSILON)


def rectangle_intersection(r: Column, t: Column) -> Column:
    """Null where they don't overlap."""
    common = F.struct(point(F.least(r.hi.x, t.hi.x), F.least(r.hi.y, t.hi.y)).alias("hi"), point(F.greatest(r.lo.x, t.lo.x), F.greatest(r.lo.y, t.lo.y)).alias("lo"))
    return F.when(rectangles_overlap(r, t), common)


def bound(r: Column, t: Column) -> Column:
    return F.struct(point(F.greatest(r.hi.x, t.hi.x), F.greatest(r.hi.y, t.hi.y)).alias("hi"), point(F.least(r.lo.x, t.lo.x), F.least(r.lo.y, t.lo.y)).alias("lo"))


# Paths and polygons.
def path(points: Column, closed: bool) -> Column:
    return F.struct(points.alias("points"), F.lit(closed).alias("closed"))


def path_length(w: Column) -> Column:
    n = F.size(w.points)
    steps = F.when(w.closed, n).otherwise(n - 1)
    sides = F.transform(F.filter(F.sequence(F.lit(1), n), lambda i: i <= steps), lambda i: distance(F.get(w.points, i - 1), F.get(w.points, i % n)))
    return F.aggregate(sides, F.lit(0.0), lambda acc, x: acc + x)


def npoints(points: Column) -> Column:
    return F.size(points)


def polygon_center(points: Column) -> Column:
    """The mean of the corners."""
    mean = lambda f: F.aggregate(F.transform(points, f), F.lit(0.0), lambda acc, x: acc + x) / F.size(points)
    return point(mean(lambda p: p.x), mean(lambda p: p.y))


def bounding_rectangle(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(point(F.array_max(xs), F.array_max(ys)).alias("hi"), point(F.array_min(xs), F.array_min(ys)).alias("lo"))


# Circles.
def circle(middle: Column, radius: Column) -> Column:
    return F.struct(middle.alias("center"), radius.cast("double").alias("radius"))


def circle_area(c: Column) -> Column:
    return F.lit(3.141592653589793) * c.radius * c.radius


def diameter(c: Column) -> Column:
    return c.radius * 2


def circle_contains_point(c: Column, a: Column) -> Column:
    return distance(c.center, a) <= c.radius


def circle_contains(c: Column, d: Column) -> Column:
    return distance(c.center, d.center) + d.radius <= c.radius + EPSILON


def circles_overlap(c: Column, d: Column) -> Column:
    return distance(c.center, d.center) <= c.radius + d.radius + EPSILON


def circle_distance(c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0.0), distance(c.center, d.center) - (c.radius + d.radius))


def circle_of_rectangle(r: Column) -> Column:
    """Through its corners."""
    return circle(center(r), distance(center(r), r.hi))
