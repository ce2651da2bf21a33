"""Temporal queries over orders and events as tables of periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import periods as P
from ..operators import temporal as T
from .registry import Registry, read

REGISTRY = Registry()
frame = REGISTRY.frame


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def ov(spark, d):
    return read(spark, d, "orders_valid")


def ev(spark, d):
    return read(spark, d, "events_valid")


A, B = "1996-01-01", "1997-01-01"
OUT = ("id", "attr", "lo", "hi")

# Truth queries: each family counts in its own semantics.
frame("t_plain_range", lambda s, d: ov(s, d).filter(P.range_overlaps("lo", "hi", ts(A), ts(B))).agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM orders_valid WHERE lo < '{B}' AND (hi IS NULL OR hi > '{A}') AND (hi IS NULL OR hi > lo)")
frame("t_composite_point", lambda s, d: ov(s, d).filter(P.box_contains("attr", "lo", "hi", F.lit(10), ts(A), ts(A))).select(*OUT), f"SELECT id, attr, lo, hi FROM orders_valid WHERE attr = 10 AND lo <= '{A}' AND (hi IS NULL OR hi >= '{A}')")
frame("t_composite_range", lambda s, d: ov(s, d).filter(P.box_overlaps("attr", "lo", "hi", F.lit(10), ts(A), ts(B))).select(*OUT), f"SELECT id, attr, lo, hi FROM orders_valid WHERE attr = 10 AND lo <= '{B}' AND (hi IS NULL OR hi >= '{A}')")
frame("t_contained_by", lambda s, d: ov(s, d).filter(P.box_contained_by("attr", "lo", "hi", F.lit(10), ts(A), ts(B))).select(*OUT), f"SELECT id, attr, lo, hi FROM orders_valid WHERE attr = 10 AND lo >= '{A}' AND hi <= '{B}'")
frame("t_current_d", lambda s, d: ov(s, d).filter(P.is_current("hi") & (F.col("attr") == 10) & (F.col("lo") <= ts("2001-01-01"))).select(*OUT), "SELECT id, attr, lo, hi FROM orders_valid WHERE hi IS NULL AND attr = 10 AND lo <= '2001-01-01'")


def hybrid(s, d):
    """History and current rows by branches of their own; equals t_composite_point counted."""
    rows = ov(s, d).filter("attr = 10")
    t = ts(A)
    history = rows.filter(F.col("hi").isNotNull() & (F.col("lo") <= t) & (F.col("hi") >= t))
    current = rows.filter(P.is_current("hi") & (F.col("lo") <= t))
    return history.unionByName(current).agg(F.count("*").alias("n"))


frame("t_hybrid_decomposed", hybrid, f"SELECT count(*) AS n FROM orders_valid WHERE attr = 10 AND lo <= '{A}' AND (hi IS NULL OR hi >= '{A}')")
frame("t_flagship_by_attr", lambda s, d: flagship(ov(s, d)), f"SELECT attr, count(*) AS n, sum(CASE WHEN hi IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_current, round(sum(price), 2) AS total FROM orders_valid WHERE lo <= '{B}' AND (hi IS NULL OR hi >= '{A}') GROUP BY attr")


def flagship(rows):
    hit = rows.filter((F.col("lo") <= ts(B)) & (F.col("hi").isNull() | (F.col("hi") >= ts(A))))
    return hit.groupBy("attr").agg(F.count("*").alias("n"), F.sum(F.when(F.col("hi").isNull(), 1).otherwise(0)).alias("n_current"), F.round(F.sum("price"), 2).alias("total"))


frame(
    "t_summary",
    lambda s, d: ov(s, d).agg(F.count("*").alias("rows"), F.count_if(F.col("hi").isNull()).alias("current"), F.count_if(F.col("hi").isNotNull()).alias("history"), F.countDistinct("attr").alias("attrs")).selectExpr("stack(4, 'rows', rows, 'current', current, 'history', history, 'attrs', attrs) AS (metric, n)"),
    "SELECT 'rows' AS metric, count(*) AS n FROM orders_valid UNION ALL SELECT 'current', count(*) FROM orders_valid WHERE hi IS NULL UNION ALL SELECT 'history', count(*) FROM orders_valid WHERE hi IS NOT NULL UNION ALL SELECT 'attrs', count(DISTINCT attr) FROM orders_valid",
)

# DML as copy on write.
NEW = "SELECT {i} + 1000000 AS id, ({i} % 100 + 1)::INT AS attr, TIMESTAMP '2002-01-01' AS lo, NULL::TIMESTAMP AS hi"
frame(
    "t_insert",
    lambda s, d: ov(s, d).select(*OUT).unionByName(s.range(1, 10001).select((F.col("id") + 1000000).alias("id"), (F.col("id") % 100 + 1).cast("int").alias("attr"), ts("2002-01-01").alias("lo"), F.lit(None).cast("timestamp_ntz").alias("hi"))).groupBy("attr").agg(F.count("*").alias("n"), F.count("hi").alias("closed")),
    f"SELECT attr, count(*) AS n, count(hi) AS closed FROM (SELECT id, attr, lo, hi FROM orders_valid UNION ALL {NEW.format(i='i')} FROM range(1, 10001) t(i)) GROUP BY attr",
)
frame("t_close_current", lambda s, d: T.close_current(ov(s, d), F.col("attr").between(1, 10), ts("2030-12-31")).select(*OUT), "SELECT id, attr, lo, CASE WHEN hi IS NULL AND attr BETWEEN 1 AND 10 THEN TIMESTAMP '2030-12-31' ELSE hi END AS hi FROM orders_valid")
frame("t_delete_history", lambda s, d: T.delete_history(ov(s, d), ts("1999-01-01"), ts("2000-01-01")).select(*OUT), "SELECT id, attr, lo, hi FROM orders_valid WHERE NOT coalesce(hi IS NOT NULL AND lo < '2000-01-01' AND hi > '1999-01-01' AND hi > lo, false)")
frame(
    "t_mbr_by_attr",
    lambda s, d: T.bounding_boxes(ov(s, d), ["key"]),
    "SELECT key, min(attr) AS attr_lo, max(attr) AS attr_hi, min(lo) AS t_lo, CASE WHEN bool_or(hi IS NULL) THEN NULL ELSE max(hi) END AS t_hi, CASE WHEN NOT bool_or(hi IS NULL) THEN 'HISTORY' WHEN bool_and(hi IS NULL) THEN 'CURRENT' ELSE 'MIXED' END AS kind FROM orders_valid GROUP BY key",
)

# Algebra.
OVERLAPS = "(l.hi IS NULL OR l.hi > l.lo) AND (r.hi IS NULL OR r.hi > r.lo) AND (r.hi IS NULL OR l.lo < r.hi) AND (l.hi IS NULL OR r.lo < l.hi)"


def sy(s, d):
    return read(s, d, "supplier_years")


frame(
    "t_interval_join",
    lambda s, d: T.overlap_totals(ov(s, d).select("id", "lo", "hi"), sy(s, d).select("id", "lo", "hi"), "id", sums=["id"]).withColumnRenamed("r_id", "ids"),
    f"SELECT l.id AS l_id, count(*) AS n, sum(r.id)::BIGINT AS ids FROM orders_valid l JOIN supplier_years r ON {OVERLAPS} GROUP BY l.id",
)
frame(
    "t_interval_join_keyed",
    lambda s, d: T.overlap_totals(ov(s, d).select("attr", "lo", "hi"), ev(s, d).select("attr", "lo", "hi"), "attr", ["attr"]),
    "SELECT l.attr AS l_attr, count(*) AS n FROM orders_valid l JOIN events_valid r ON l.attr = r.attr AND (r.hi IS NULL OR l.lo < r.hi) AND (l.hi IS NULL OR r.lo < l.hi) AND (l.hi IS NULL OR l.hi > l.lo) AND (r.hi IS NULL OR r.hi > r.lo) GROUP BY l.attr",
)
frame(
    "t_stab_join",
    lambda s, d: T.stab_join(read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), (F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).alias("t")), ov(s, d).select("id", "key", "lo", "hi"), "t", ["key"], 180).select("o_orderkey", F.col("p_id").alias("valid_id")),
    "SELECT o_orderkey, v.id AS valid_id FROM orders o JOIN orders_valid v ON o.o_custkey = v.key AND v.lo <= o_orderdate + INTERVAL 10 DAYS AND (v.hi IS NULL OR v.hi > o_orderdate + INTERVAL 10 DAYS) AND (v.hi IS NULL OR v.hi > v.lo)",
)
frame(
    "t_asof",
    lambda s, d: T.asof_join(read(s, d, "events").select("event_id", "user_id", "ts"), read(s, d, "orders").withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 20 YEARS")), "ts", "o_orderdate", "user_id", "o_custkey", ["o_orderdate", "o_orderkey"]).select("event_id", "o_orderkey"),
    "SELECT event_id, o_orderkey FROM (SELECT event_id, o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS r FROM events LEFT JOIN orders ON user_id = o_custkey AND o_orderdate + INTERVAL 20 YEARS <= ts) WHERE r = 1",
)
COAL = """SELECT {k}, min(lo) AS lo, CASE WHEN max(h) = TIMESTAMP '9999-12-31' THEN NULL ELSE max(h) END AS hi FROM (
  SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY lo, h ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN lo <= max(h) OVER (PARTITION BY {k} ORDER BY lo, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM (
      SELECT {k}, lo, coalesce(hi, TIMESTAMP '9999-12-31') AS h FROM {t} WHERE hi IS NULL OR hi > lo))) GROUP BY {k}, g"""
frame("t_coalesce", lambda s, d: T.coalesce_periods(ov(s, d).filter("price < 100000"), ["attr"]), COAL.format(k="attr", t="(SELECT * FROM orders_valid WHERE price < 100000)"))
frame(
    "t_intersect_agg",
    lambda s, d: T.intersect_periods(ov(s, d).filter("hi IS NULL OR hi > lo").filter("hi IS NULL OR price > 450000"), ["attr"]),
    "SELECT attr, max(lo) AS lo, min(hi) AS hi FROM orders_valid WHERE (hi IS NULL OR hi > lo) AND (hi IS NULL OR price > 450000) GROUP BY attr HAVING min(hi) IS NULL OR max(lo) < min(hi)",
)
frame(
    "t_minus",
    lambda s, d: T.subtract_periods(ov(s, d).filter("price < 50000"), ov(s, d).filter("price > 200000"), ["attr"]),
    f"""WITH a AS ({COAL.format(k='attr', t='(SELECT * FROM orders_valid WHERE price < 50000)')}), b AS ({COAL.format(k='attr', t='(SELECT * FROM orders_valid WHERE price > 200000)')}),
    e AS (SELECT attr, lo AS t, 1 AS k, 0 AS c FROM a UNION ALL SELECT attr, coalesce(hi, TIMESTAMP '9999-12-31'), -1, 0 FROM a UNION ALL SELECT attr, lo, 0, 1 FROM b UNION ALL SELECT attr, coalesce(hi, TIMESTAMP '9999-12-31'), 0, -1 FROM b),
    g AS (SELECT attr, t, sum(k) AS k, sum(c) AS c FROM e GROUP BY attr, t),
    s AS (SELECT attr, t AS lo, lead(t) OVER w AS h, sum(k) OVER (w ROWS UNBOUNDED PRECEDING) AS k, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM g WINDOW w AS (PARTITION BY attr ORDER BY t)),
    r AS (SELECT attr, lo, CASE WHEN h < TIMESTAMP '9999-12-31' THEN h END AS hi FROM s WHERE k > 0 AND c = 0)
    {COAL.format(k='attr', t='r')}""",
)
frame(
    "t_sweep",
    lambda s, d: T.timeline(ov(s, d), ["attr"]),
    "SELECT attr, t, sum(d) OVER (PARTITION BY attr ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM (SELECT attr, t, sum(d) AS d FROM (SELECT attr, lo AS t, 1 AS d FROM orders_valid WHERE hi IS NULL OR hi > lo UNION ALL SELECT attr, hi, -1 FROM orders_valid WHERE hi > lo) GROUP BY attr, t)",
)
frame("t_snapshot", lambda s, d: T.snapshot(ov(s, d), ts("1998-06-15")).select(*OUT), "SELECT id, attr, lo, hi FROM orders_valid WHERE lo <= '1998-06-15' AND (hi IS NULL OR hi > '1998-06-15')")
frame(
    "t_exclusion_violations",
    lambda s, d: T.overlap_violations(ov(s, d), ["attr"], "id").select(*OUT),
    "SELECT a.id, a.attr, a.lo, a.hi FROM orders_valid a WHERE (a.hi IS NULL OR a.hi > a.lo) AND EXISTS (SELECT 1 FROM orders_valid b WHERE b.attr = a.attr AND (b.hi IS NULL OR b.hi > b.lo) AND (b.lo < a.lo OR (b.lo = a.lo AND b.id < a.id)) AND (b.hi IS NULL OR b.hi > a.lo))",
)
frame(
    "t_fk_in_time",
    lambda s, d: ev(s, d).select("id", "attr", "lo").join(T.coalesce_periods(ov(s, d).filter("price < 50000"), ["attr"]).select(F.col("attr").alias("a"), F.col("lo").alias("l"), F.col("hi").alias("h")), (F.col("attr") == F.col("a")) & (F.col("l") <= F.col("lo")) & P.ends_after("h", "lo"), "left_anti").select("id", "attr", "lo"),
    "SELECT id, attr, lo FROM events_valid e WHERE NOT EXISTS (SELECT 1 FROM orders_valid v WHERE v.price < 50000 AND v.attr = e.attr AND v.lo <= e.lo AND (v.hi IS NULL OR v.hi > e.lo))",
)
PAIR = "FROM orders_valid a JOIN orders_valid b ON a.key = b.key AND a.id <> b.id AND (a.hi IS NULL OR a.hi > a.lo) AND (b.hi IS NULL OR b.hi > b.lo)"


def pairs(s, d):
    """Rows of one key with each other: two pairs of period columns."""
    rows = ov(s, d).filter(~P.is_empty("lo", "hi"))
    r = rows.select(F.col("key"), F.col("id").alias("id2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return rows.join(r, "key").filter("id <> id2")


frame("t_adjacent", lambda s, d: pairs(s, d).filter(P.range_adjacent("lo", "hi", "lo2", "hi2")).groupBy("attr").agg(F.count("*").alias("n")), f"SELECT a.attr, count(*) AS n {PAIR} WHERE a.hi = b.lo OR b.hi = a.lo GROUP BY a.attr")
frame(
    "t_before_after",
    lambda s, d: pairs(s, d).groupBy("attr").agg(*[F.count_if(c).alias(n) for n, c in (("before", P.range_before("hi", "lo2")), ("after", P.range_after("lo", "hi2")), ("overleft", P.range_overleft("hi", "hi2")), ("overright", P.range_overright("lo", "lo2")))]),
    f"SELECT a.attr, count(*) FILTER (WHERE a.hi <= b.lo) AS before, count(*) FILTER (WHERE a.lo >= b.hi) AS after, count(*) FILTER (WHERE b.hi IS NULL OR a.hi <= b.hi) AS overleft, count(*) FILTER (WHERE a.lo >= b.lo) AS overright {PAIR} GROUP BY a.attr",
)
ALLEN_SQL = """CASE WHEN x.hi < y.lo THEN 'before' WHEN x.hi = y.lo THEN 'meets' WHEN x.lo > y.hi THEN 'after' WHEN x.lo = y.hi THEN 'met_by'
 WHEN x.lo = y.lo AND x.h = y.h THEN 'equals' WHEN x.lo = y.lo AND x.h < y.h THEN 'starts' WHEN x.lo = y.lo THEN 'started_by'
 WHEN x.h = y.h AND x.lo > y.lo THEN 'finishes' WHEN x.h = y.h THEN 'finished_by' WHEN x.lo > y.lo AND x.h < y.h THEN 'during'
 WHEN x.lo < y.lo AND x.h > y.h THEN 'contains' WHEN x.lo < y.lo THEN 'overlaps' ELSE 'overlapped_by' END"""


def allen(s, d):
    return pairs(s, d).groupBy("attr", P.allen("lo", "hi", "lo2", "hi2").alias("relation")).agg(F.count("*").alias("n"))


frame("t_allen", allen, f"SELECT attr, {ALLEN_SQL} AS relation, count(*) AS n FROM (SELECT *, coalesce(hi, TIMESTAMP '9999-12-31') AS h FROM orders_valid WHERE hi IS NULL OR hi > lo) x JOIN (SELECT key, id AS id2, lo, hi, coalesce(hi, TIMESTAMP '9999-12-31') AS h FROM orders_valid WHERE hi IS NULL OR hi > lo) y ON x.key = y.key AND x.id <> y.id2 GROUP BY 1, 2")
frame(
    "t_range_accessors",
    lambda s, d: ov(s, d).select("id", F.when(~P.is_empty("lo", "hi"), F.col("lo")).alias("lower"), F.when(~P.is_empty("lo", "hi"), F.col("hi")).alias("upper"), P.is_current("hi").alias("upper_inf"), P.is_empty("lo", "hi").alias("isempty")),
    "SELECT id, CASE WHEN hi IS NULL OR hi > lo THEN lo END AS lower, CASE WHEN hi > lo THEN hi END AS upper, hi IS NULL AS upper_inf, coalesce(hi <= lo, false) AS isempty FROM orders_valid",
)


def crossed(s, d):
    """What periods of neighbouring suppliers cover together and have in common."""
    left, right = sy(s, d).withColumn("peer", F.col("key") + 1), sy(s, d).withColumnRenamed("key", "peer")
    both = T.overlap_join(left.select("id", "peer", "lo", "hi"), right.select("id", "peer", "lo", "hi"), 365, ["peer"])
    ends = F.col("l_hi").isNotNull() & F.col("r_hi").isNotNull()
    return both.select("l_id", "r_id", F.least("l_lo", "r_lo").alias("merge_lo"), F.when(ends, F.greatest("l_hi", "r_hi")).alias("merge_hi"), F.greatest("l_lo", "r_lo").alias("cut_lo"), F.least("l_hi", "r_hi").alias("cut_hi"))


frame(
    "t_range_merge_intersect",
    crossed,
    f"SELECT l.id AS l_id, r.id AS r_id, least(l.lo, r.lo) AS merge_lo, CASE WHEN l.hi IS NOT NULL AND r.hi IS NOT NULL THEN greatest(l.hi, r.hi) END AS merge_hi, greatest(l.lo, r.lo) AS cut_lo, least(l.hi, r.hi) AS cut_hi FROM supplier_years l JOIN supplier_years r ON r.key = l.key + 1 AND {OVERLAPS}",
)
frame(
    "t_scd2_close_out",
    lambda s, d: T.periods_from_events(read(s, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", F.col("o_custkey") % 100 + 1).groupBy("o_custkey").agg(F.count("*").alias("versions"), F.count_if(F.col("hi").isNull()).alias("current")),
    "SELECT key AS o_custkey, count(*) AS versions, count(*) FILTER (WHERE hi IS NULL) AS current FROM orders_valid GROUP BY key",
)
