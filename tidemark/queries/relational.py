"""Joins, subqueries, set operations, sorting, limits, modifying statements and table functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Registry, read

REGISTRY = Registry()
frame, same, pair = REGISTRY.frame, REGISTRY.same, REGISTRY.pair

# Projection and predicates.
same("p_projection", "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderpriority) AS pri, o_orderkey % 7 AS m FROM orders")
same("p_filter_3vl", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 5000 OR NULLIF(c_nationkey, 3) = 5)")
same("p_between_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW')")
pair("p_between_symmetric", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN least(200000, 100000) AND greatest(200000, 100000)", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
pair("p_any_array", "SELECT o_orderkey FROM orders WHERE array_contains(array(1, 5, 9), o_custkey)", "SELECT o_orderkey FROM orders WHERE o_custkey = ANY([1, 5, 9])")
same("p_is_distinct", "SELECT count(*) AS n FROM orders_valid WHERE hi IS NOT DISTINCT FROM NULL")
pair("p_row_comparison", "SELECT o_orderkey FROM orders WHERE struct(o_custkey, o_orderkey) < struct(100L, 500L)", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) < (100, 500)")
same("p_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), 'none') AS st FROM orders")
same("p_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%' AND p_brand LIKE 'Brand#1_'")
pair("p_regex", "SELECT p_partkey FROM part WHERE p_brand RLIKE '#[1-3][1-5]$' AND p_name ILIKE '%A%'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-3][1-5]$') AND p_name ILIKE '%A%'")
same("p_casts", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,1)) AS d, CAST(o_orderkey AS VARCHAR(20)) AS v, CAST(CAST('2020-01-31' AS DATE) AS VARCHAR(10)) AS dt FROM orders")
same("p_boolean_tests", "SELECT count(*) AS n FROM orders_valid WHERE ((hi > TIMESTAMP '1997-01-01') IS TRUE) OR ((hi > TIMESTAMP '1997-01-01') IS NULL)")

# Joins.
same("j_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 1000")
same("j_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
same("j_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000")
same("j_full", "SELECT a.c_custkey AS x, b.s_suppkey AS y FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey * 20")
same("j_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("j_natural_using", "SELECT n_nationkey, r_name, k FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT n_nationkey, n_nationkey * 2 AS k FROM nation) z USING (n_nationkey)")
same("j_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
same("j_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
same("j_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
same("j_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
frame("j_not_in_null_aware", lambda s, d: R.not_in(read(s, d, "customer").select("c_custkey"), "c_custkey", read(s, d, "orders").select(F.expr("nullif(o_custkey, 7)").alias("k")), "k"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders)")
# Spark ranks a lateral ORDER BY ... LIMIT by the order in which a shuffle happens to deliver the rows; so the rank is written out.
pair(
    "j_lateral",
    "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey NULLS LAST) AS r FROM orders) z WHERE o_custkey = c_custkey AND r <= 2) t",
    "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
)
same("j_theta", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
same("j_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
same("j_star", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
pair("j_merge_hint", "SELECT /*+ MERGE(orders) */ c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey", "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")
pair("j_hash_hint", "SELECT /*+ SHUFFLE_HASH(customer) */ c_nationkey, max(o_totalprice) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey", "SELECT c_nationkey, max(o_totalprice) AS m FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey")


def knn_per_key(s, d):
    """Three customers a supplier of its nation; rows of one supplier key are ranked together."""
    found = R.nearest(read(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), read(s, d, "customer"), "s_nationkey", "s_acctbal", "c_nationkey", "c_acctbal", "c_custkey", 3)
    w = Window.partitionBy("s_suppkey").orderBy(F.asc_nulls_last("distance"), F.asc_nulls_last("c_custkey"))
    return found.withColumn("r", F.row_number().over(w)).filter("r <= 3").select("s_suppkey", "c_custkey")


frame("j_knn_per_key", knn_per_key, "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), c_custkey) AS r FROM supplier JOIN customer ON s_nationkey = c_nationkey) z WHERE r <= 3")

# Subqueries.
same("q_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
same("q_uncorrelated", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
pair("q_op_any_all", "SELECT p_partkey FROM part WHERE p_retailprice >= (SELECT max(p_retailprice) - 100 FROM part) OR p_size < (SELECT min(p_size) + 2 FROM part)", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice - 100 FROM part) OR p_size < ANY (SELECT min(p_size) + 2 FROM part)")
pair("q_array_subquery", "SELECT n_regionkey, array_join(array_sort(collect_list(n_nationkey)), ',') AS keys FROM nation GROUP BY n_regionkey", "SELECT r_regionkey AS n_regionkey, array_to_string(ARRAY(SELECT n_nationkey FROM nation WHERE n_regionkey = r_regionkey ORDER BY 1), ',') AS keys FROM region")
same("q_values", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
same("q_cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n")
same("q_derived", "SELECT st, sum(n) AS n FROM (SELECT o_orderstatus AS st, 1 AS n FROM orders) z GROUP BY st")

# Set operations.
same("s_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
same("s_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
same("s_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
same("s_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
same("s_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
same("s_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")

# Recursion.
same("r_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")


def reachable(s, d):
    """Keys reached from 1 by n -> 2n and n -> n + 7 under 500: UNION drops what was seen."""
    step = lambda f: f.select((F.col("n") * 2).alias("n")).unionByName(f.select((F.col("n") + 7).alias("n"))).filter("n < 500")
    return R.recursive_distinct(s.range(1, 2).select(F.col("id").alias("n")), step)


frame("r_recursive_distinct", reachable, "WITH RECURSIVE t(n) AS (SELECT 1::BIGINT UNION SELECT x FROM (SELECT unnest([n * 2, n + 7]) AS x FROM t) WHERE x < 500) SELECT n FROM t")
frame(
    "r_connectby",
    lambda s, d: R.connect_by(s.range(1, 41).select("id", F.when(F.col("id") > 1, F.expr("id div 3")).alias("up")).filter("id = 1 OR up >= 1"), "id", "up", F.col("id") == 1),
    "WITH RECURSIVE e AS (SELECT i AS id, i // 3 AS up FROM range(2, 41) t(i) WHERE i // 3 >= 1), t(id, up, level, branch) AS (SELECT 1::BIGINT, NULL::BIGINT, 0, '1' UNION ALL SELECT e.id, e.up, level + 1, branch || '~' || e.id FROM t JOIN e ON e.up = t.id) SELECT id, up, level, branch FROM t",
)

# Distinct, order, limit.
same("d_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
frame("d_distinct_on", lambda s, d: R.distinct_on(read(s, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey"), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
frame("l_with_ties", lambda s, d: R.top_with_ties(read(s, d, "part"), 5, [(F.col("p_size"), "desc")]).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) z WHERE r <= 5")
frame("l_with_ties_per_key", lambda s, d: R.with_ties(read(s, d, "orders"), 1, [F.col("o_orderdate").desc()], ["o_custkey"]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) z WHERE r = 1")
same("l_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
same("l_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 1000")
same("l_nulls_order", "SELECT id, hi FROM orders_valid ORDER BY hi ASC NULLS FIRST, id LIMIT 50")
same("l_order_by_expr", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal) DESC NULLS LAST, 1 LIMIT 30")

# Modifying statements, copy on write.
frame(
    "m_update_from",
    lambda s, d: R.after(R.update_from(read(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), read(s, d, "nation").filter("n_regionkey = 1").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], {"c_acctbal": F.col("t.c_acctbal") + 10})).drop("c_nationkey"),
    "SELECT c_custkey, CASE WHEN n_name IS NOT NULL THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) n ON c_nationkey = n_nationkey",
)
frame(
    "m_delete_using",
    lambda s, d: R.after(R.delete_using(read(s, d, "orders").select("o_orderkey", "o_custkey"), read(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"], F.col("s.c_acctbal") < 0)).select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)",
)
frame(
    "m_delete_returning",
    lambda s, d: R.delete_using(read(s, d, "orders").select("o_orderkey", "o_custkey"), read(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"], F.col("s.c_acctbal") < 0).filter("action = 'delete'").select("o_orderkey", "o_custkey"),
    "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0",
)


def merge(s, d):
    target = read(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    source = read(s, d, "supplier").select((F.col("s_suppkey") * 30).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("c_nationkey"))
    return R.merge_into(target, source, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("s.c_acctbal")}, delete=F.col("s.c_acctbal") < 0)


frame(
    "m_merge",
    merge,
    "WITH s AS (SELECT s_suppkey * 30 AS k, s_acctbal AS b, s_nationkey AS n FROM supplier) SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN b WHEN k IS NULL THEN c_acctbal ELSE c_acctbal + b END AS c_acctbal, coalesce(c_nationkey, n) AS c_nationkey FROM customer FULL JOIN s ON c_custkey = k WHERE NOT coalesce(c_custkey IS NOT NULL AND k IS NOT NULL AND b < 0, false)",
)
frame(
    "m_on_conflict_do_nothing",
    lambda s, d: R.merge_into(read(s, d, "nation"), read(s, d, "nation").withColumn("n_nationkey", F.col("n_nationkey") + 10).withColumn("n_name", F.lower("n_name")), ["n_nationkey"], {}),
    "SELECT * FROM nation UNION ALL SELECT n_nationkey + 10, lower(n_name), n_regionkey FROM nation WHERE n_nationkey + 10 NOT IN (SELECT n_nationkey FROM nation)",
)


def upserted(s, d):
    """INSERT ... ON CONFLICT DO UPDATE."""
    new = read(s, d, "nation").select((F.col("n_nationkey") + 10).alias("n_nationkey"), F.lower("n_name").alias("n_name"), "n_regionkey")
    return R.after(R.insert_on_conflict(read(s, d, "nation"), new, ["n_nationkey"], {"n_name": F.concat("t.n_name", F.lit("/"), "s.n_name")}))


frame(
    "m_on_conflict_do_update",
    upserted,
    "SELECT coalesce(a.n_nationkey, b.n_nationkey + 10) AS n_nationkey, CASE WHEN b.n_name IS NULL THEN a.n_name WHEN a.n_name IS NULL THEN lower(b.n_name) ELSE a.n_name || '/' || lower(b.n_name) END AS n_name, coalesce(a.n_regionkey, b.n_regionkey) AS n_regionkey FROM nation a FULL JOIN nation b ON a.n_nationkey = b.n_nationkey + 10",
)


def merged_actions(s, d):
    """MERGE ... RETURNING merge_action(), with clauses by source too."""
    target = read(s, d, "customer").select("c_custkey", "c_acctbal")
    source = read(s, d, "supplier").select((F.col("s_suppkey") * 30).alias("c_custkey"), F.col("s_acctbal").alias("b"))
    changes = R.merge(
        target, source, ["c_custkey"],
        matched=[(F.col("s.b") < 0, "delete"), (F.col("t.c_acctbal") > 5000, "nothing"), (None, {"c_acctbal": F.col("s.b")})],
        not_matched=[(F.col("s.b") > 0, {"c_acctbal": F.col("s.b")})],
        not_matched_by_source=[(F.col("t.c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})],
    )
    return changes


frame(
    "m_merge_actions",
    merged_actions,
    """WITH s AS (SELECT s_suppkey * 30 AS k, s_acctbal AS b FROM supplier)
    SELECT CASE WHEN k IS NULL AND c_acctbal < 0 THEN 'update' WHEN k IS NULL THEN 'keep' WHEN c_custkey IS NULL THEN 'insert' WHEN b < 0 THEN 'delete' WHEN c_acctbal > 5000 THEN 'keep' ELSE 'update' END AS action,
      coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NULL THEN greatest(c_acctbal, 0) WHEN c_custkey IS NULL THEN b WHEN b < 0 OR c_acctbal > 5000 THEN c_acctbal ELSE b END AS c_acctbal
    FROM customer FULL JOIN s ON c_custkey = k WHERE c_custkey IS NOT NULL OR b > 0""",
)
frame(
    "m_moved",
    lambda s, d: (lambda x: x[0].withColumn("side", F.lit("old")).unionByName(x[1].withColumn("side", F.lit("new"))))(R.moved(read(s, d, "orders").select("o_orderkey", "o_orderstatus"), read(s, d, "orders").select("o_orderkey", "o_orderstatus").filter("false"), F.col("o_orderstatus") == "F")),
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS side FROM orders",
)

# Table functions and sampling.
pair("tf_generate_series", "SELECT explode(sequence(1, 20, 3)) AS n", "SELECT n::INT AS n FROM generate_series(1, 20, 3) t(n)")
pair("tf_generate_series_time", "SELECT explode(sequence(TIMESTAMP_NTZ'2020-01-01', TIMESTAMP_NTZ'2020-01-03', INTERVAL 6 HOURS)) AS t", "SELECT t FROM generate_series(TIMESTAMP '2020-01-01', TIMESTAMP '2020-01-03', INTERVAL 6 HOURS) z(t)")
pair("tf_unnest_ordinality", "SELECT n_regionkey, pos + 1 AS ord, name FROM (SELECT n_regionkey, posexplode(array_sort(collect_list(n_name))) AS (pos, name) FROM nation GROUP BY n_regionkey)", "SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)::INT AS ord, n_name AS name FROM nation")
pair("tf_rows_from", "SELECT z.a, z.b FROM (SELECT explode(arrays_zip(a, b)) AS z FROM (SELECT array(1, 2, 3) AS a, array('x', 'y') AS b))", "SELECT * FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) v(a, b)")
frame("tf_crosstab", lambda s, d: R.crosstab(read(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n")), "o_orderpriority", "o_orderstatus", "n", ["F", "O", "P"]), "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY o_orderpriority")
pair("tf_unpivot", "SELECT c_custkey, stack(2, 'bal', c_acctbal, 'nation', double(c_nationkey)) AS (k, v) FROM customer", "SELECT c_custkey, 'bal' AS k, c_acctbal AS v FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::DOUBLE FROM customer")
pair("tf_string_to_table", "SELECT n_nationkey, explode(split(n_name, 'A')) AS part FROM nation", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS part FROM nation")
frame(
    "tf_tablesample",
    lambda s, d: (lambda a, b: a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), "o_orderkey", "full").agg((F.abs(F.count("x") / read(s, d, "orders").count() - 0.1) < 0.03).alias("share"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("differing")))(*[R.sample_rows(read(s, d, "orders"), 0.1, 7).select("o_orderkey") for _ in range(2)]),
    "SELECT true AS share, 0 AS differing",
)
frame("tf_normal_rand", lambda s, d: s.range(20000).select((F.randn(7) * 2 + 5).alias("x")).agg((F.abs(F.avg("x") - 5) < 0.1).alias("mean"), (F.abs(F.stddev("x") - 2) < 0.1).alias("deviation"), (F.abs(F.avg((F.col("x") < 7).cast("int")) - 0.8413) < 0.02).alias("shape")), "SELECT true AS mean, true AS deviation, true AS shape")
