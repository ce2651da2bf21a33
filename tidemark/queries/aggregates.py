"""Aggregate functions, grouping sets, ordered-set and hypothetical-set aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Registry, read

REGISTRY = Registry()
frame, same, pair = REGISTRY.frame, REGISTRY.same, REGISTRY.pair

same("a_count", "SELECT count(*) AS n, count(hi) AS n_hi, count(DISTINCT attr) AS n_attr FROM orders_valid")
pair("a_sum_avg", "SELECT l_returnflag, sum(l_linenumber) AS s, round(avg(l_quantity), 6) AS a, round(sum(l_extendedprice), 2) AS e FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS s, round(avg(l_quantity), 6) AS a, round(sum(l_extendedprice), 2) AS e FROM lineitem GROUP BY l_returnflag")
same("a_min_max", "SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, min(o_orderpriority) AS p, max(o_totalprice) AS m FROM orders GROUP BY o_custkey")
same("a_q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
same("a_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 300000")
pair("a_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 2) AS s FROM orders GROUP BY o_custkey", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 2) AS s FROM orders GROUP BY o_custkey")
pair("a_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
pair("a_array_agg", "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> x.n_name), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey), '|') AS names FROM nation GROUP BY n_regionkey")
same("a_bool", "SELECT attr, bool_and(hi IS NULL) AS every, bool_or(hi IS NULL) AS some FROM orders_valid GROUP BY attr")
same("a_bits", "SELECT o_orderstatus, bit_and(o_custkey) AS a, bit_or(o_custkey) AS o, bit_xor(o_custkey) AS x FROM orders GROUP BY o_orderstatus")
same("a_any_value", "SELECT n_regionkey, any_value(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
same("a_dispersion", "SELECT o_orderstatus, round(stddev_pop(o_totalprice), 3) AS sp, round(stddev_samp(o_totalprice), 3) AS ss, round(var_pop(o_totalprice) / 1e6, 3) AS vp, round(var_samp(o_totalprice) / 1e6, 3) AS vs FROM orders GROUP BY o_orderstatus")
same("a_dispersion_single", "SELECT c_custkey, stddev_samp(c_acctbal) AS s, var_pop(c_acctbal) AS v FROM customer GROUP BY c_custkey")
same("a_regression", "SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay, round(regr_sxx(l_extendedprice, l_quantity), 0) AS sxx, round(regr_sxy(l_extendedprice, l_quantity), 0) AS sxy FROM lineitem GROUP BY l_linestatus")
same("a_percentile_cont", "SELECT o_orderstatus, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 6) AS p90 FROM orders GROUP BY o_orderstatus")
same("a_percentile_disc", "SELECT o_orderstatus, percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1, percentile_disc(0.75) WITHIN GROUP (ORDER BY o_totalprice DESC) AS q3 FROM orders GROUP BY o_orderstatus")
pair("a_mode", "SELECT p_brand, m.s AS mode FROM (SELECT p_brand, min_by(struct(p_size AS s), struct(-n, p_size)) AS m FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size) GROUP BY p_brand)", "SELECT p_brand, p_size AS mode FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS r FROM part GROUP BY p_brand, p_size) z WHERE r = 1")
frame(
    "a_hypothetical",
    lambda s, d: R.hypothetical_rank(read(s, d, "orders"), ["o_orderstatus"], "o_totalprice", F.lit(150000.0)).select("o_orderstatus", "rank", "dense_rank", F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist")),
    "SELECT o_orderstatus, 1 + count(*) FILTER (WHERE o_totalprice < 150000) AS rank, 1 + count(DISTINCT o_totalprice) FILTER (WHERE o_totalprice < 150000) AS dense_rank, round(count(*) FILTER (WHERE o_totalprice < 150000) / count(*), 9) AS percent_rank, round((count(*) FILTER (WHERE o_totalprice <= 150000) + 1) / (count(*) + 1), 9) AS cume_dist FROM orders GROUP BY o_orderstatus",
)
same("a_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2 FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
same("a_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("a_cube", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)")
same("a_cube_rollup", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag), ROLLUP (l_linestatus, l_linenumber)")
pair("a_group_by_distinct", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same("a_group_expr", "SELECT extract(year FROM o_orderdate) AS y, count(*) AS n FROM orders GROUP BY extract(year FROM o_orderdate)")
same("a_distinct_multi", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
pair("a_sum_wide", "SELECT cast(sum(cast(o_orderkey AS DECIMAL(38, 0)) * 1000000000000) AS STRING) AS s FROM orders", "SELECT (sum(o_orderkey::HUGEINT * 1000000000000))::VARCHAR AS s FROM orders")
pair("a_first_last", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS f, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS l FROM orders GROUP BY o_custkey", "SELECT o_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS f, last(o_orderkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY o_custkey")
pair("a_json_agg", "SELECT n_regionkey, to_json(transform(array_sort(collect_list(struct(n_nationkey, n_name))), x -> x.n_nationkey)) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
pair("a_product", "SELECT n_regionkey, round(exp(sum(ln(n_nationkey + 1))), 3) AS p FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, round(product(n_nationkey + 1), 3) AS p FROM nation GROUP BY n_regionkey")
pair("a_approx_distinct", "SELECT CASE WHEN abs(approx_count_distinct(o_custkey, 0.02) / count(DISTINCT o_custkey) - 1) < 0.1 THEN 'close' END AS verdict FROM orders", "SELECT 'close' AS verdict")
same("a_distinct_from_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
