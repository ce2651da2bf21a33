"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Registry, read

REGISTRY = Registry()
frame, same, pair = REGISTRY.frame, REGISTRY.same, REGISTRY.pair

W = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
same("w_ranks", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
same("w_relative_ranks", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS nt FROM part")
same("w_lag_lead", f"SELECT o_orderkey, lag(o_orderkey, 1) OVER {W} AS a, lag(o_orderkey, 2, -1) OVER {W} AS b, lead(o_totalprice) OVER {W} AS c FROM orders")
same("w_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER {W} AS f, last_value(o_orderkey) OVER {W} AS l, nth_value(o_orderkey, 2) OVER {W} AS n FROM orders")
same("w_running_sum", f"SELECT o_orderkey, round(sum(o_totalprice) OVER {W}, 2) AS s, count(*) OVER {W} AS n, max(o_totalprice) OVER {W} AS m FROM orders")
same("w_rows_frame", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS a FROM orders")
pair("w_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS n FROM orders")
same("w_range_numeric", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
frame("w_groups_frame", lambda s, d: R.groups_frame_sum(read(s, d, "part"), ["p_brand"], "p_size", "p_partkey", 1, 1, "s").select("p_partkey", "s"), "SELECT p_partkey, (sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::BIGINT AS s FROM part")
for what in ("CURRENT ROW", "GROUP", "TIES"):
    frame(
        f"w_exclude_{what.split()[0].lower()}",
        lambda s, d, what=what: R.exclude_sum(read(s, d, "part"), ["p_brand"], "p_size", "p_partkey", what, "s").select("p_partkey", "s"),
        f"SELECT p_partkey, (sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {what}))::BIGINT AS s FROM part",
    )
same("w_named", "SELECT o_orderkey, row_number() OVER w AS r, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
same("w_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) z WHERE r <= 3")
pair("w_filter", f"SELECT o_orderkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER {W} AS f FROM orders", f"SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER {W} AS f FROM orders")
pair("w_distinct", f"SELECT o_orderkey, CAST(size(collect_set(o_orderstatus) OVER {W}) AS BIGINT) AS n FROM orders", f"SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER {W} AS n FROM orders")
same("w_gaps_islands", "SELECT user_id, min(d) AS a, max(d) AS b, count(*) AS n FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM (SELECT DISTINCT user_id, CAST(extract(day FROM ts) AS INT) AS d FROM events) x) y GROUP BY user_id, g")
same("w_session", "SELECT user_id, s, count(*) AS n, min(ts) AS t FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2' HOUR THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, s")
same("w_share", "SELECT c_custkey, round(c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey), 9) AS share FROM customer")
pair("w_ignore_nulls", "SELECT id, last_value(CASE WHEN price > 200000 THEN id END) IGNORE NULLS OVER (PARTITION BY key ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_big FROM orders_valid", "SELECT id, last_value(CASE WHEN price > 200000 THEN id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY lo, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_big FROM orders_valid")
same("w_whole_partition", "SELECT l_orderkey, l_linenumber, round(max(l_extendedprice) OVER (PARTITION BY l_orderkey) - l_extendedprice, 2) AS gap FROM lineitem")
