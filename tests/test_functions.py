"""Ranges, geometry, times and search on values whose results are known."""

import datetime as dt
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as G
from tidemark.functions import ranges as R
from tidemark.functions import search as S
from tidemark.functions import system as Y
from tidemark.functions import times as D


@pytest.fixture(scope="module")
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()["x"]


def ints(lo, hi, bounds="[)"):
    return R.make_range(F.lit(lo).cast("int"), F.lit(hi).cast("int"), bounds)


def shown(r):
    return "empty" if r["empty"] else f"{'[' if r['lo_inc'] else '('}{'' if r['lo'] is None else r['lo']},{'' if r['hi'] is None else r['hi']}{']' if r['hi_inc'] else ')'}"


def test_ranges(one):
    assert shown(one(R.union(ints(1, 5), ints(5, 9)))) == "[1,9)"
    assert shown(one(R.union(ints(1, 5, "(]"), ints(3, None)))) == "(1,)"
    assert shown(one(R.minus(ints(1, 9), ints(5, 20)))) == "[1,5)"
    assert shown(one(R.minus(ints(1, 9), ints(0, 5, "[]")))) == "(5,9)"
    assert shown(one(R.minus(ints(1, 9), ints(0, 20)))) == "empty"
    for bad in (R.union(ints(1, 2), ints(5, 6)), R.minus(ints(1, 9), ints(3, 4))):
        with pytest.raises(Exception, match="contiguous"):
            one(bad)
    assert one(R.contains_range(ints(1, 9), ints(2, 9))) and not one(R.contains_range(ints(1, 9), ints(2, 9, "[]")))
    assert one(R.lower_inf(ints(None, 3))) and not one(R.upper_inf(ints(None, 3)))
    assert one(R.overleft(ints(1, 5), ints(2, 5))) and one(R.overright(ints(2, 9), ints(2, 5)))
    order = [ints(3, 3), ints(None, 2), ints(1, 2), ints(1, 3), ints(1, None), ints(2, 3)]
    assert [one(R.range_cmp(a, b)) for a, b in zip(order, order[1:])] == [-1] * 5 and one(R.range_cmp(order[3], order[3])) == 0


def multi(*members):
    return R.multirange(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in members]))


def test_multiranges(one, spark):
    plain = lambda m: [(r["lo"], r["hi"]) for r in m]
    assert plain(one(R.multirange_union(multi((1, 3)), multi((2, 5), (7, 9))))) == [(1, 5), (7, 9)]
    assert plain(one(R.multirange_minus(multi((1, 10)), multi((2, 3), (5, 7))))) == [(1, 2), (3, 5), (7, 10)]
    assert one(R.multirange_overlaps(multi((1, 3)), multi((2, 5)))) and not one(R.multirange_overlaps(multi((1, 3)), multi((3, 5))))
    assert one(R.multirange_contains_all(multi((1, 10)), multi((2, 3), (5, 7)))) and one(R.multirange_before(multi((1, 2)), multi((2, 3))))
    assert one(R.multirange_adjacent(multi((1, 2), (4, 5)), multi((5, 6)))) and one(R.multirange_overleft(multi((1, 2)), multi((0, 2))))
    assert spark.range(1).select(R.unnest_multirange(multi((1, 2), (4, 5)))).count() == 2


def test_boxes(one):
    box = lambda ll, ur: R.box(F.array(*map(F.lit, ll)), F.array(*map(F.lit, ur)))
    a, b = box([1.0, 2.0], [3.0, 4.0]), box([1.0, 2.0], [3.0, 5.0])
    assert one(R.box_cmp(a, b)) == -1 and one(R.box_cmp(b, a)) == 1 and one(R.box_cmp(a, a)) == 0
    assert one(R.box_dim(a)) == 2 and one(R.box_lower(a, 2)) == 2 and one(R.box_upper(a, 3)) == 0 and one(R.box_coordinate(a, 3)) == 3
    assert one(R.box_sort_coordinate(a, 4)) == 4 and one(R.box_sort_coordinate(a, -1)) == -1
    assert one(R.box_is_point(box([1.0], [1.0]))) and one(R.box_contained(a, b))
    assert one(R.box_subset(a, [2, 2]))["ur"] == [4, 4] and one(R.box_with_dim(a, F.lit(7.0)))["ll"] == [1, 2, 7]


def pt(x, y):
    return G.point(F.lit(x), F.lit(y))


def test_geometry(one):
    s, t = G.segment(pt(0, 0), pt(4, 0)), G.segment(pt(2, -1), pt(2, 3))
    assert one(G.segments_intersect(s, t)) and one(G.is_perpendicular(s, t)) and one(G.is_horizontal(s)) and one(G.is_vertical(t))
    assert one(G.segment_distance(s, G.segment(pt(0, 3), pt(9, 3)))) == 3 and one(G.point_to_segment(pt(7, 4), s)) == 5
    assert one(G.closest_on_segment(s, pt(1, 9)))["x"] == 1 and one(G.midpoint(t))["y"] == 1 and one(G.length(t)) == 4
    u, v = G.line(pt(0, 0), pt(1, 1)), G.line(pt(0, 2), pt(2, 0))
    assert one(G.lines_perpendicular(u, v)) and one(G.lines_meet(u, v)) == (1.0, 1.0) and one(G.lines_meet(u, u)) is None
    assert abs(one(G.point_to_line(pt(0, 2), u)) - math.sqrt(2)) < 1e-9 and one(G.point_to_line(pt(5, 1), G.line(pt(2, 0), pt(2, 9)))) == 3
    r, q = G.rectangle(pt(0, 0), pt(4, 2)), G.rectangle(pt(5, 1), pt(3, 9))
    assert one(G.area(r)) == 8 and one(G.rectangles_overlap(r, q)) and one(G.area(G.rectangle_intersection(r, q))) == 1 and one(G.area(G.bound(r, q))) == 45
    assert one(G.center(r)) == (2.0, 1.0) and one(G.rectangle_contains(r, G.rectangle(pt(1, 1), pt(2, 2)))) and one(G.width(r)) == 4
    square = F.array(pt(0, 0), pt(3, 0), pt(3, 4), pt(0, 4))
    assert one(G.path_length(G.path(square, True))) == 14 and one(G.path_length(G.path(square, False))) == 10
    assert one(G.polygon_center(square)) == (1.5, 2.0) and one(G.area(G.bounding_rectangle(square))) == 12
    c, d = G.circle(pt(0, 0), F.lit(5)), G.circle(pt(3, 0), F.lit(1))
    assert one(G.circle_contains(c, d)) and one(G.circles_overlap(c, d)) and one(G.circle_distance(d, G.circle(pt(9, 0), F.lit(2)))) == 3
    assert abs(one(G.circle_area(d)) - math.pi) < 1e-12 and one(G.circle_contains_point(c, pt(3, 4))) and one(G.diameter(c)) == 10
    assert one(G.multiply(pt(1, 2), pt(3, 4))) == (-5.0, 10.0) and one(G.divide(pt(-5, 10), pt(3, 4))) == (1.0, 2.0)
    assert one(G.slope(pt(0, 0), pt(0, 5))) == math.inf and one(G.is_left(pt(0, 0), pt(1, 0)))


def test_times(one):
    hour = 3600 * D.US
    assert one(D.time_text(D.time_of(F.lit(8), F.lit(15), F.lit(23.5)))) == "08:15:23.5"
    assert tuple(one(D.justify_hours(D.interval(us=27 * hour)))) == (0, 1, 3 * hour)
    assert tuple(one(D.justify_hours(D.interval(days=1, us=-hour)))) == (0, 0, 23 * hour)
    assert tuple(one(D.justify_days(D.interval(days=35)))) == (1, 5, 0) and tuple(one(D.justify_days(D.interval(months=1, days=-1)))) == (0, 29, 0)
    assert tuple(one(D.justify_interval(D.interval(months=1, us=-hour)))) == (0, 29, 23 * hour)
    assert one(D.interval_cmp(D.interval(months=1), D.interval(days=30))) == 0 and one(D.interval_cmp(D.interval(days=1), D.interval(us=23 * hour))) == 1
    t = F.lit("2021-03-07 05:06:07.123456").cast("timestamp_ntz")
    for template, want in (("YYYY-MM-DD HH24:MI:SS.US", "2021-03-07 05:06:07.123456"), ("FMMonth FMDDth, YYYY", "March 7th, 2021"), ("DAY|Dy|mon", "SUNDAY   |Sun|mar"), ('"Q"Q IYYY-IW ID J', "Q1 2021-09 7 2459281"), ("HH12:MI AM", "05:06 AM"), ("CC WW W D", "21 10 1 1")):
        assert one(D.to_char(t, template)) == want
    assert one(D.current("current_date")) == one(F.current_date()) and one(D.current("now") <= F.current_timestamp()) and 0 <= one(D.current("localtime")) < D.DAY_US
    assert one(D.is_finite(F.lit(dt.date(2020, 1, 1)))) is True


@pytest.mark.parametrize("word,want", [("running", "run"), ("cats", "cat"), ("ponies", "poni"), ("relational", "relat"), ("generously", "generous"), ("communication", "communic"), ("happiness", "happi"), ("skies", "sky"), ("dying", "die"), ("hoping", "hope"), ("hopping", "hop"), ("nationality", "nation"), ("controlling", "control"), ("owed", "owe"), ("consistently", "consist"), ("knightly", "knight"), ("gas", "gas"), ("this", "this"), ("agreed", "agre"), ("rate", "rate"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("luxuriating", "luxuri")])
def test_stems(word, want):
    assert S.stem(word) == want


def test_search(one):
    v = S.to_vector(F.lit("The Fat Rats ate a fat-cat's meals"))
    assert one(S.vector_text(S.to_vector(F.lit("The Fat Rats")))) == "'fat':2 'rat':3"
    assert "fat-cat" in one(S.lexemes_of(v))
    text = lambda q: S.query_text(q)
    assert text(S.parse("The & Fat & Rats")) == "'fat' & 'rat'" and text(S.plain("The Fat Rats")) == "'fat' & 'rat'"
    assert text(S.phrase("The Fat and Rats")) == "'fat' <2> 'rat'" and text(S.websearch('"fat rat" or cat -dog')) == "'fat' <-> 'rat' | 'cat' & !'dog'"
    assert text(S.parse("super:*a & (star | !wars)")) == "'super':*A & ( 'star' | !'war' )" and S.numnode(S.parse("fat & rat | cat")) == 5
    for query, want in (("fat & rat", True), ("fat <-> rat", True), ("rat <-> fat", False), ("fat <2> ate", True), ("!dog & mea:*", True), ("rat:A", False)):
        assert one(S.matches(v, S.parse(query))) is want
    assert one(S.matches(S.set_weight(v, "A"), S.parse("rat:A"))) and one(F.size(S.filter_weights(v, "A"))) == 0
    assert text(S.rewrite(S.parse("a1 & b1"), S.parse("a1"), S.parse("c1 | d1"))) == "( 'c1' | 'd1' ) & 'b1'" and S.query_contains(S.parse("cat & rat"), S.parse("rat"))
    assert abs(one(S.rank(S.to_vector(F.lit("cat")), S.parse("cat"))) - 0.1 / 1.64493406685) < 1e-9
    assert abs(one(S.rank(S.to_vector(F.lit("fat cat")), S.parse("fat & cat"))) - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(1 / 1.5 - 2)))) < 1e-9
    assert one(S.headline(F.lit("Fat cats run"), S.parse("cat & running"))) == "Fat <b>cats</b> <b>run</b>"
    assert one(S.vector_text(S.joined(S.to_vector(F.lit("fat cat")), S.to_vector(F.lit("cat"))))) == "'cat':2,3 'fat':1"
    assert one(S.vector_text(S.strip(S.delete_lexemes(v, "fat", "rat", "ate")))).startswith("'cat'")
    with pytest.raises(ValueError):
        S.parse("fat & & rat")


def test_uuids(one):
    for name in ("", "example", "ü"):
        assert one(Y.uuid_v3("dns", F.lit(name))) == str(uuid.uuid3(uuid.NAMESPACE_DNS, name)) and one(Y.uuid_v5("url", F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    u = uuid.uuid1()
    assert one(Y.uuid_timestamp(F.lit(str(u)))).timestamp() == pytest.approx((u.time - 0x01B21DD213814000) / 1e7, abs=1e-5)
    assert one(Y.uuid_timestamp(F.lit("017f22e2-79b0-7cc3-98c4-dc0c0c07398f")).cast("double")) == 1645557742.0
    assert one(Y.uuid_timestamp(Y.uuid_v4())) is None and one(Y.uuid_version(F.lit("11111111-1111-1111-1111-111111111111"))) is None


@pytest.mark.parametrize("n,want", [(0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (1000000, "977 kB"), (-10240, "-10 kB"), (10 * 1024**2, "10 MB"), (10 * 1024**2 - 513, "10239 kB"), (5 * 1024**4, "5120 GB"), (1000000000000000, "909 TB")])
def test_sizes(one, n, want):
    assert one(Y.size_pretty(F.lit(n))) == want


def test_partition_tree(spark, tmp_path):
    spark.range(4).selectExpr("id", "id % 2 AS a", "id AS b").write.partitionBy("a", "b").parquet(str(tmp_path / "t"))
    got = {(r["relid"], r["parentrelid"], r["isleaf"], r["level"]) for r in Y.partition_tree(spark, str(tmp_path / "t")).collect()}
    assert ("", None, False, 0) in got and ("a=1", "", False, 1) in got and ("a=1/b=3", "a=1", True, 2) in got and len(got) == 7
