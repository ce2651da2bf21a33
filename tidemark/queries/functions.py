"""Scalar functions: text, numbers, time, arrays, JSON, ranges, boxes, geometry, networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc as M
from ..functions import ranges as G
from ..functions import search as T
from ..functions import text as X
from .registry import Registry, read

REGISTRY = Registry()
frame, same, pair = REGISTRY.frame, REGISTRY.same, REGISTRY.pair


def select(name: str, table: str, columns: dict, sql: str) -> None:
    """A projection of table: columns by name, against SQL."""
    frame(name, lambda s, d: read(s, d, table).select(*[c().alias(n) for n, c in columns.items()]), sql)


c = F.col
key = lambda: c("p_partkey")

# Text.
pair("f_str_case", "SELECT p_partkey, lower(p_name) AS l, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, octet_length(p_name) AS o, bit_length(p_name) AS b FROM part", "SELECT p_partkey, lower(p_name) AS l, upper(p_name) AS u, length(p_name) AS n, strlen(p_name)::INT AS o, bit_length(p_name)::INT AS b FROM part")
pair("f_str_trim_pad", "SELECT p_partkey, btrim(p_name, 'pt ') AS b, ltrim('pt', p_name) AS l, rtrim('0123', p_name) AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 5, '-') AS rp FROM part", "SELECT p_partkey, trim(p_name, 'pt ') AS b, ltrim(p_name, 'pt') AS l, rtrim(p_name, '0123') AS r, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 5, '-') AS rp FROM part")
select("f_str_left_right", "part", {"p_partkey": key, "a": lambda: X.left(c("p_type"), 3), "b": lambda: X.left(c("p_type"), -2), "d": lambda: X.right(c("p_type"), 3), "e": lambda: X.right(c("p_type"), -2)}, "SELECT p_partkey, left(p_type, 3) AS a, left(p_type, -2) AS b, right(p_type, 3) AS d, right(p_type, -2) AS e FROM part")
select("f_str_substring", "part", {"p_partkey": key, "a": lambda: X.substring(c("p_type"), 2, 3), "b": lambda: X.substring(c("p_type"), -1, 4)}, "SELECT p_partkey, substring(p_type, 2, 3) AS a, substring(p_type, 1, 2) AS b FROM part")
pair("f_str_position", "SELECT p_partkey, position('a' IN p_name) AS a, instr(p_type, 'E') AS b, startswith(p_type, 'S') AS c FROM part", "SELECT p_partkey, position('a' IN p_name)::INT AS a, strpos(p_type, 'E')::INT AS b, starts_with(p_type, 'S') AS c FROM part")
select("f_str_overlay", "part", {"p_partkey": key, "a": lambda: X.overlay(c("p_brand"), "XX", 2), "b": lambda: X.overlay(c("p_brand"), "YYY", 3, 1)}, "SELECT p_partkey, p_brand[1:1] || 'XX' || substr(p_brand, 4) AS a, p_brand[1:2] || 'YYY' || substr(p_brand, 4) AS b FROM part")
pair("f_str_replace", "SELECT p_partkey, replace(p_name, 'a', '<a>') AS a, translate(p_type, 'AEIOU', 'aei') AS b, repeat(p_brand, 2) AS c, reverse(p_name) AS d FROM part", "SELECT p_partkey, replace(p_name, 'a', '<a>') AS a, replace(replace(translate(p_type, 'AEI', 'aei'), 'O', ''), 'U', '') AS b, repeat(p_brand, 2) AS c, reverse(p_name) AS d FROM part")
select("f_str_split_part", "part", {"p_partkey": key, "a": lambda: X.split_part(c("p_brand"), "#", 1), "b": lambda: X.split_part(c("p_brand"), "#", -1), "d": lambda: X.split_part(c("p_name"), " ", 9)}, "SELECT p_partkey, split_part(p_brand, '#', 1) AS a, split_part(p_brand, '#', -1) AS b, split_part(p_name, ' ', 9) AS d FROM part")
frame("f_str_concat", lambda s, d: read(s, d, "customer").select("c_custkey", X.concat_skipping_nulls(c("c_name"), F.lit(None), c("c_mktsegment")).alias("a"), F.concat_ws("-", "c_name", F.lit(None), "c_mktsegment").alias("b"), F.concat(c("c_name"), F.lit("!")).alias("d")), "SELECT c_custkey, concat(c_name, NULL, c_mktsegment) AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b, c_name || '!' AS d FROM customer")
frame("f_str_quote", lambda s, d: read(s, d, "nation").select("n_nationkey", X.quote_literal(F.concat(c("n_name"), F.lit("'s"))).alias("a"), X.quote_nullable(F.nullif(c("n_name"), F.lit("x"))).alias("b"), X.quote_ident(c("n_name")).alias("d")), "SELECT n_nationkey, '''' || n_name || '''''s''' AS a, '''' || n_name || '''' AS b, CASE WHEN regexp_matches(n_name, '^[a-z_][a-z0-9_$]*$') THEN n_name ELSE '\"' || n_name || '\"' END AS d FROM nation")
frame("f_str_parse_ident", lambda s, d: s.sql("SELECT 'Foo.\"Bar b\".baz' AS t").select(F.array_join(X.parse_ident(c("t")), "|").alias("a")), "SELECT 'foo|Bar b|baz' AS a")
frame("f_str_initcap", lambda s, d: read(s, d, "part").select("p_partkey", X.initcap(F.replace(F.concat(c("p_name"), F.lit("-x y")), F.lit("#"), F.lit("_"))).alias("a")).select("p_partkey", F.length("a").cast("long").alias("n"), F.right("a", F.lit(3)).alias("z")), "SELECT p_partkey, length(p_name) + 4 AS n, 'X Y' AS z FROM part")
pair("f_str_codes", "SELECT n_nationkey, ascii(n_name) AS a, chr(65 + n_nationkey) AS b, lower(hex(n_nationkey * 12345)) AS c FROM nation", "SELECT n_nationkey, ascii(n_name) AS a, chr(65 + n_nationkey) AS b, lower(to_hex(n_nationkey * 12345)) AS c FROM nation")
same("f_str_digests", "SELECT n_nationkey, md5(n_name) AS m FROM nation")
pair("f_str_sha", "SELECT n_nationkey, sha2(n_name, 256) AS a, lower(hex(n_name)) AS b, base64(n_name) AS c, decode(unbase64(base64(n_name)), 'UTF-8') AS d FROM nation", "SELECT n_nationkey, sha256(n_name) AS a, lower(hex(n_name)) AS b, base64(encode(n_name)) AS c, n_name AS d FROM nation")
pair("f_str_regex", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'N') AS a, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS b, array_join(split(p_name, '[ #]+'), '|') AS c, regexp_count(p_name, 'a') AS d FROM part", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]', 'N', 'g') AS a, regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2) AS b, array_to_string(regexp_split_to_array(p_name, '[ #]+'), '|') AS c, len(regexp_extract_all(p_name, 'a'))::INT AS d FROM part")
frame("f_str_regexp_match", lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(X.regexp_match(c("p_brand"), "([A-Za-z]+)#1([0-9])", 2), ",").alias("a")), "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '[A-Za-z]+#1[0-9]') THEN regexp_extract(p_brand, '([A-Za-z]+)#1([0-9])', 1) || ',' || regexp_extract(p_brand, '([A-Za-z]+)#1([0-9])', 2) END AS a FROM part")
pair("f_str_levenshtein", "SELECT a.n_nationkey AS x, b.n_nationkey AS y, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "SELECT a.n_nationkey AS x, b.n_nationkey AS y, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
frame("f_str_levenshtein_bounded", lambda s, d: read(s, d, "nation").select("n_nationkey", X.levenshtein_less_equal(c("n_name"), F.lit("NATION_1"), 2).cast("long").alias("d")), "SELECT n_nationkey, least(levenshtein(n_name, 'NATION_1'), 3) AS d FROM nation")
frame("f_str_soundex", lambda s, d: s.sql("SELECT * FROM VALUES ('Robert', 'Rupert'), ('Anne', 'Andrew'), ('Tymczak', 'Pfister') AS t(a, b)").select("a", F.soundex("a").alias("sa"), X.soundex_difference(c("a"), c("b")).alias("d")), "SELECT * FROM (VALUES ('Robert', 'R163', 4), ('Anne', 'A500', 2), ('Tymczak', 'T522', 0)) t(a, sa, d)")
frame("f_str_trigram", lambda s, d: s.sql("SELECT * FROM VALUES ('word', 'two words'), ('cat', 'cat'), ('', 'x') AS t(a, b)").select("a", F.size(X.trigrams(c("a"))).alias("n"), F.round(X.similarity(c("a"), c("b")), 6).alias("s")), "SELECT * FROM (VALUES ('word', 5, 0.363636), ('cat', 4, 1.0), ('', 0, 0.0)) t(a, n, s)")
frame("f_str_unaccent", lambda s, d: s.sql("SELECT 'Hôtel straße Œuvre' AS a").select(X.unaccent(c("a")).alias("a")), "SELECT 'Hotel strasse OEuvre' AS a")
frame("f_str_to_array", lambda s, d: s.sql("SELECT 'a,b,,d' AS t").select(F.array_join(X.string_to_array(c("t"), ",", "b"), "|", "NULL").alias("a")), "SELECT 'a|NULL||d' AS a")

# Numbers.
pair("f_math_basic", "SELECT p_partkey, abs(p_retailprice - 1000) AS a, p_partkey % 7 AS m, p_partkey div 7 AS d, sign(p_size - 25) AS s, ceil(p_retailprice) AS c, floor(p_retailprice) AS f FROM part", "SELECT p_partkey, abs(p_retailprice - 1000) AS a, p_partkey % 7 AS m, p_partkey // 7 AS d, sign(p_size - 25)::DOUBLE AS s, ceil(p_retailprice)::BIGINT AS c, floor(p_retailprice)::BIGINT AS f FROM part")
same("f_math_power", "SELECT p_partkey, round(sqrt(p_retailprice), 9) AS a, round(cbrt(p_retailprice), 9) AS b, round(power(p_size, 2.5), 6) AS c, round(exp(p_size / 10.0), 6) AS d, round(ln(p_retailprice), 9) AS e, round(log10(p_retailprice), 9) AS f FROM part")
same("f_math_trig", "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(atan2(p_size, 3), 9) AS a, round(degrees(p_size), 6) AS d, round(radians(p_size), 9) AS r, round(cot(p_size), 6) AS ct, round(tanh(p_size), 9) AS th FROM part")
pair("f_math_round", "SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS r, CAST(CAST(p_retailprice AS BIGINT) AS DOUBLE) AS t, round(pi(), 9) AS p FROM part", "SELECT p_partkey, round(p_retailprice::DECIMAL(12,2), 1)::DOUBLE AS r, trunc(p_retailprice) AS t, round(pi(), 9) AS p FROM part")
pair("f_math_integer", "SELECT n_nationkey, factorial(n_nationkey % 15) AS f, bit_count(n_nationkey) AS b, getbit(n_nationkey, 1) AS g, shiftleft(n_nationkey, 3) AS s, n_nationkey & 6 AS a, n_nationkey | 8 AS o, n_nationkey ^ 5 AS x FROM nation", "SELECT n_nationkey, factorial(n_nationkey % 15)::BIGINT AS f, bit_count(n_nationkey)::INT AS b, ((n_nationkey >> 1) & 1)::TINYINT AS g, n_nationkey << 3 AS s, n_nationkey & 6 AS a, n_nationkey | 8 AS o, xor(n_nationkey, 5) AS x FROM nation")


def gcds(s, d):
    """gcd by Euclid's steps as a fold of fixed length: 64-bit integers need fewer than 93."""
    step = lambda acc, _: F.when(acc.b == 0, acc).otherwise(F.struct(acc.b.alias("a"), (acc.a % acc.b).alias("b")))
    a, b = c("p_partkey"), c("p_size").cast("long")
    g = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.alias("a"), b.alias("b")), step, lambda acc: acc.a)
    return read(s, d, "part").select("p_partkey", g.alias("gcd"), (a * b / g).cast("long").alias("lcm"))


frame("f_math_gcd_lcm", gcds, "SELECT p_partkey, gcd(p_partkey, p_size)::BIGINT AS gcd, lcm(p_partkey, p_size)::BIGINT AS lcm FROM part")
pair("f_math_width_bucket", "SELECT p_partkey, width_bucket(p_retailprice, 900.0, 1900.0, 10) AS b FROM part", "SELECT p_partkey, CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 1900 THEN 11 ELSE floor((p_retailprice - 900) / 100) + 1 END::BIGINT AS b FROM part")
same("f_math_greatest", "SELECT p_partkey, greatest(p_size, 10, nullif(p_size, 5)) AS g, least(p_size, 10) AS l FROM part")
frame("f_math_num_nulls", lambda s, d: read(s, d, "orders_valid").select("id", M.num_nulls(c("hi"), c("lo"), F.nullif(c("attr"), F.lit(5))).alias("n")), "SELECT id, (hi IS NULL)::INT + (lo IS NULL)::INT + (attr = 5)::INT AS n FROM orders_valid")

# Time.
pair("f_date_extract", "SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(quarter FROM o_orderdate) AS q, extract(month FROM o_orderdate) AS m, extract(week FROM o_orderdate) AS w, extract(doy FROM o_orderdate) AS dy, extract(dow FROM o_orderdate) - 1 AS dw, extract(yearofweek FROM o_orderdate) AS iy FROM orders", "SELECT o_orderkey, extract(year FROM o_orderdate)::INT AS y, extract(quarter FROM o_orderdate)::INT AS q, extract(month FROM o_orderdate)::INT AS m, extract(week FROM o_orderdate)::INT AS w, extract(doy FROM o_orderdate)::INT AS dy, extract(dow FROM o_orderdate)::INT AS dw, extract(isoyear FROM o_orderdate)::INT AS iy FROM orders")
pair("f_date_trunc", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, CAST(date_trunc('week', ts) AS TIMESTAMP_NTZ) AS w, CAST(date_trunc('quarter', ts) AS TIMESTAMP_NTZ) AS q FROM events", "SELECT event_id, date_trunc('hour', ts)::TIMESTAMP AS h, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('quarter', ts)::TIMESTAMP AS q FROM events")
frame("f_date_bin", lambda s, d: read(s, d, "events").select("event_id", M.date_bin(15 * 60 * 1_000_000, c("ts"), F.lit("2001-01-01").cast("timestamp_ntz")).alias("b")), "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2001-01-01') AS b FROM events")
same("f_date_arith", "SELECT o_orderkey, o_orderdate + INTERVAL '1' MONTH AS m, o_orderdate - INTERVAL '36' HOUR AS h, o_orderdate + INTERVAL '1' YEAR AS y FROM orders")
pair("f_date_diff", "SELECT o_orderkey, CAST(datediff(l_shipdate, o_orderdate) AS BIGINT) AS d, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey, date_diff('day', o_orderdate, l_shipdate) AS d, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
pair("f_date_make", "SELECT n_nationkey, CAST(make_date(2000 + n_nationkey, 2, 28) AS STRING) AS d, make_timestamp_ntz(2000, 1, n_nationkey + 1, 3, 4, 5) AS t FROM nation", "SELECT n_nationkey, make_date(2000 + n_nationkey, 2, 28)::VARCHAR AS d, make_timestamp(2000, 1, n_nationkey + 1, 3, 4, 5) AS t FROM nation")
pair("f_date_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd HH:mm') AS f FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f FROM orders")
pair("f_date_parse", "SELECT n_nationkey, to_timestamp_ntz(concat('2021-03-', lpad(n_nationkey + 1, 2, '0')), 'yyyy-MM-dd') AS t FROM nation", "SELECT n_nationkey, strptime('2021-03-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0'), '%Y-%m-%d') AS t FROM nation")
pair("f_date_epoch", "SELECT event_id, CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS BIGINT) AS us FROM events", "SELECT event_id, epoch_us(ts) AS us FROM events")
frame(
    "f_date_overlaps",
    lambda s, d: read(s, d, "orders_valid").filter("hi IS NOT NULL").select("id", M.overlaps_periods(c("lo"), c("hi"), F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1997-06-01").cast("timestamp_ntz")).alias("o")),
    "SELECT id, (least(lo, hi) < '1998-01-01' AND '1997-06-01' < greatest(lo, hi)) OR lo = '1997-06-01' AS o FROM orders_valid WHERE hi IS NOT NULL",
)
pair("f_date_zone", "SELECT event_id, CAST(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'America/New_York') AS TIMESTAMP_NTZ) AS t FROM events", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events")

# Arrays.
A = "(SELECT n_regionkey, array_sort(collect_list(n_nationkey)) AS a FROM nation GROUP BY n_regionkey)"
DA = "(SELECT n_regionkey, array_agg(n_nationkey ORDER BY n_nationkey) AS a FROM nation GROUP BY n_regionkey)"
J = lambda e: f"array_join({e}, ',')"
DJ = lambda e: f"array_to_string({e}, ',')"
pair("f_arr_build", f"SELECT n_regionkey, {J('array_append(a, 99)')} AS p, {J('array_prepend(a, 0)')} AS q, {J('concat(a, a)')} AS r, {J('array_remove(a, 5)')} AS s, {J('array_repeat(7, 3)')} AS t FROM {A}", f"SELECT n_regionkey, {DJ('list_append(a, 99)')} AS p, {DJ('list_prepend(0, a)')} AS q, {DJ('list_concat(a, a)')} AS r, {DJ('list_filter(a, lambda x: x <> 5)')} AS s, '7,7,7' AS t FROM {DA}")
pair("f_arr_access", f"SELECT n_regionkey, size(a) AS n, try_element_at(a, 2) AS e, try_element_at(a, 9) AS z, {J('slice(a, 2, 2)')} AS s, CAST(array_position(a, 6) AS INT) AS p FROM {A}", f"SELECT n_regionkey, len(a)::INT AS n, a[2] AS e, a[9] AS z, {DJ('a[2:3]')} AS s, coalesce(list_position(a, 6), 0)::INT AS p FROM {DA}")
pair("f_arr_sets", f"SELECT n_regionkey, arrays_overlap(a, array(1, 2)) AS o, array_contains(a, 7) AS c, size(array_intersect(a, array(5, 6, 7))) = 3 AS k, {J('array_sort(array_union(a, array(1, 2)))')} AS u, {J('array_except(a, array(5, 6))')} AS x FROM {A}", f"SELECT n_regionkey, list_has_any(a, [1, 2]) AS o, list_contains(a, 7) AS c, list_has_all(a, [5, 6, 7]) AS k, {DJ('list_sort(list_distinct(list_concat(a, [1, 2])))')} AS u, {DJ('list_filter(a, lambda x: x NOT IN (5, 6))')} AS x FROM {DA}")
pair("f_arr_sort", f"SELECT n_regionkey, {J('sort_array(a, false)')} AS d, {J('array_distinct(transform(a, x -> x % 3))')} AS u, aggregate(a, 0, (x, y) -> x + y) AS s, array_max(a) AS m, forall(a, x -> x < 24) AS al, exists(a, x -> x = 3) AS an FROM {A}", f"SELECT n_regionkey, {DJ('list_reverse_sort(a)')} AS d, {DJ('list_transform(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: y % 3), x % 3) = i), lambda x: x % 3)')} AS u, list_sum(a)::INT AS s, list_max(a) AS m, list_max(a) < 24 AS al, list_contains(a, 3) AS an FROM {DA}")

# JSON: events.props.
pair("f_json_access", "SELECT event_id, get_json_object(props, '$.k') AS k, json_array_length(concat('[', event_id, ',2]')) AS n FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, 2 AS n FROM events")
pair("f_json_build", "SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS o, to_json(array(n_nationkey, n_regionkey)) AS a FROM nation", "SELECT n_nationkey, json_object('id', n_nationkey, 'name', n_name)::VARCHAR AS o, json_array(n_nationkey, n_regionkey)::VARCHAR AS a FROM nation")
pair("f_json_keys", "SELECT array_join(json_object_keys('{\"a\": 1, \"b\": [1, 2]}'), ',') AS k, get_json_object('{\"a\": {\"b\": [10, 20]}}', '$.a.b[1]') AS v", "SELECT array_to_string(json_keys('{\"a\": 1, \"b\": [1, 2]}'), ',') AS k, json_extract_string('{\"a\": {\"b\": [10, 20]}}', '$.a.b[1]') AS v")
pair("f_json_rows", "SELECT id, x.a AS a, x.b AS b FROM (SELECT n_nationkey AS id, explode(from_json(concat('[{\"a\":', n_nationkey, ',\"b\":\"', n_name, '\"},{\"a\":-1}]'), 'array<struct<a:int,b:string>>')) AS x FROM nation)", "SELECT n_nationkey AS id, n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT n_nationkey, -1, NULL FROM nation")
pair("f_json_variant", "SELECT n_nationkey, variant_get(parse_json(concat('{\"x\":{\"y\":[', n_nationkey, ',5]}}')), '$.x.y[0]', 'int') AS v, schema_of_variant(parse_json('[1,2]')) AS s FROM nation", "SELECT n_nationkey, n_nationkey AS v, 'ARRAY<BIGINT>' AS s FROM nation")
pair("f_map_hstore", "SELECT n_nationkey, m['k'] AS k, map_contains_key(m, 'z') AS z, size(map_concat(m, map('q', '1'))) AS n, array_join(array_sort(map_keys(map_filter(m, (k, v) -> v <> 'x'))), ',') AS f FROM (SELECT n_nationkey, map('k', n_name, 'x', 'x') AS m FROM nation)", "SELECT n_nationkey, n_name AS k, false AS z, 3 AS n, 'k' AS f FROM nation")

# Ranges, boxes, geometry.
frame(
    "f_range_bounds",
    lambda s, d: read(s, d, "nation").select("n_nationkey", G.make_range(c("n_nationkey"), c("n_nationkey") + c("n_regionkey"), "(]", F.lit(1)).alias("r")).select("n_nationkey", "r.lo", "r.hi", "r.empty", G.contains_elem(c("r"), F.lit(7)).alias("has7"), G.adjacent(c("r"), G.make_range(F.lit(0), F.lit(8))).alias("adj"), G.overlaps(c("r"), G.make_range(F.lit(5), F.lit(9), "[]")).alias("o"), G.strictly_left(c("r"), G.make_range(F.lit(10), F.lit(None).cast("int"))).alias("l")),
    "SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_nationkey + 1 END AS lo, CASE WHEN n_regionkey > 0 THEN n_nationkey + n_regionkey + 1 END AS hi, n_regionkey = 0 AS empty, n_regionkey > 0 AND n_nationkey < 7 AND n_nationkey + n_regionkey >= 7 AS has7, n_regionkey > 0 AND (n_nationkey + 1 = 8 OR n_nationkey + n_regionkey + 1 = 0) AS adj, n_regionkey > 0 AND n_nationkey + 1 <= 9 AND n_nationkey + n_regionkey >= 5 AS o, n_regionkey > 0 AND n_nationkey + n_regionkey + 1 <= 10 AS l FROM nation",
)


def multi(s, d):
    rows = read(s, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(c("n_nationkey").alias("lo"), (c("n_nationkey") + c("n_nationkey") % 7).alias("hi"))).alias("p"))
    m = rows.select("n_regionkey", G.multirange(c("p")).alias("m"))
    other = F.array(F.struct(F.lit(3).alias("lo"), F.lit(12).alias("hi")))
    return m.select("n_regionkey", F.array_join(F.transform("m", lambda p: F.concat_ws("-", p.lo.cast("string"), p.hi.cast("string"))), ",").alias("m"), G.multirange_contains(c("m"), F.lit(9)).alias("has9"), G.multirange_span(G.multirange_intersect(c("m"), other)).alias("cut"))


frame(
    "f_multirange",
    multi,
    """WITH p AS (SELECT n_regionkey AS k, n_nationkey AS lo, n_nationkey + n_nationkey % 7 AS hi FROM nation WHERE n_nationkey % 7 > 0),
    n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM p),
    g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM n),
    m AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, g)
    SELECT k AS n_regionkey, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS m, bool_or(lo <= 9 AND 9 < hi) AS has9, sum(greatest(least(hi, 12) - greatest(lo, 3), 0))::DOUBLE AS cut FROM m GROUP BY k""",
)
BOXES = lambda: (G.box(F.array(c("n_nationkey").cast("double"), F.lit(0.0)), F.array(c("n_nationkey") + 3.0, c("n_regionkey").cast("double"))), G.box(F.array(F.lit(10.0), F.lit(2.0)), F.array(F.lit(8.0), F.lit(5.0))))


def boxes(s, d):
    a, b = BOXES()
    rows = read(s, d, "nation").select("n_nationkey", a.alias("a"), b.alias("b"))
    a, b = c("a"), c("b")
    union = G.box_union(a, b)
    return rows.select("n_nationkey", G.box_overlaps(a, b).alias("o"), G.box_contains(union, a).alias("k"), G.box_size(union).alias("u"), F.round(G.box_distance(a, b), 9).alias("d"), G.box_taxicab(a, b).alias("t"), G.box_chebyshev(a, b).alias("ch"), G.box_size(G.box_enlarge(a, 1.0)).alias("e"))


frame(
    "f_cube",
    boxes,
    """WITH v AS (SELECT n_nationkey, n_nationkey::DOUBLE AS x1, n_nationkey + 3.0::DOUBLE AS x2, 0.0::DOUBLE AS y1, n_regionkey::DOUBLE AS y2, greatest(n_nationkey - 10, 8 - (n_nationkey + 3), 0)::DOUBLE AS gx, greatest(2 - n_regionkey, -5, 0)::DOUBLE AS gy FROM nation)
    SELECT n_nationkey, x1 <= 10 AND 8 <= x2 AND 2 <= y2 AS o, true AS k, (greatest(x2, 10) - least(x1, 8)) * (5 - 0.0::DOUBLE) AS u, round(sqrt(gx * gx + gy * gy), 9) AS d, gx + gy AS t, greatest(gx, gy) AS ch, (x2 - x1 + 2) * (y2 - y1 + 2) AS e FROM v""",
)
frame(
    "f_geometry",
    lambda s, d: read(s, d, "nation").select("n_nationkey", F.round(G.point_distance(c("n_nationkey"), c("n_regionkey"), F.lit(3), F.lit(4)), 9).alias("d"), G.polygon_contains(F.expr("array(named_struct('x', 0.0, 'y', 0.0), named_struct('x', 10.0, 'y', 0.0), named_struct('x', 0.0, 'y', 10.0))"), c("n_nationkey") + 0.5, c("n_regionkey") + 0.25).alias("inside"), G.polygon_area(F.expr("array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 4.0D, 'y', 0.0D), named_struct('x', 4.0D, 'y', 3.0D))")).alias("area"), F.round(G.earth_distance(F.lit(48.0), F.lit(2.0), F.lit(48.0) + c("n_nationkey"), F.lit(2.0)), 3).alias("m")),
    "SELECT n_nationkey, round(sqrt(power(n_nationkey - 3, 2) + power(n_regionkey - 4, 2)), 9) AS d, (n_nationkey + 0.5 + n_regionkey + 0.25) < 10 AS inside, 6.0::DOUBLE AS area, round(radians(n_nationkey) * 6378168.0, 3) AS m FROM nation",
)

# Networks, trees, codes, search.
frame(
    "f_net_inet",
    lambda s, d: read(s, d, "nation").select("n_nationkey", F.concat(F.lit("10.1."), c("n_regionkey").cast("string"), F.lit("."), (c("n_nationkey") * 9).cast("string"), F.lit("/26")).alias("a")).select("n_nationkey", M.network(c("a")).alias("net"), M.broadcast_address(c("a")).alias("bc"), M.masklen(c("a")).alias("len"), M.subnet_contains(F.lit("10.1.0.0/23"), c("a")).alias("sub")),
    "SELECT n_nationkey, '10.1.' || n_regionkey || '.' || (n_nationkey * 9 // 64 * 64) || '/26' AS net, '10.1.' || n_regionkey || '.' || (n_nationkey * 9 // 64 * 64 + 63) AS bc, 26 AS len, n_regionkey < 2 AS sub FROM nation",
)
frame("f_ltree", lambda s, d: read(s, d, "nation").select("n_nationkey", F.concat_ws(".", F.lit("top"), c("n_regionkey").cast("string"), c("n_name")).alias("p")).select("n_nationkey", M.nlevel(c("p")).alias("n"), M.subpath(c("p"), 1, 2).alias("s"), M.is_ancestor(F.lit("top.1"), c("p")).alias("u")), "SELECT n_nationkey, 3 AS n, n_regionkey || '.' || n_name AS s, n_regionkey = 1 AS u FROM nation")
frame("f_isn", lambda s, d: s.sql("SELECT * FROM VALUES ('978020137962'), ('400638133393') AS t(x)").select("x", M.ean13_check_digit(c("x")).alias("d")), "SELECT * FROM (VALUES ('978020137962', 4), ('400638133393', 1)) t(x, d)")
frame("f_uuid_version", lambda s, d: s.range(5).select("id", F.substring(F.expr("uuid()"), 15, 1).alias("v")), "SELECT id, '4' AS v FROM range(5) t(id)")
frame(
    "f_text_search",
    lambda s, d: s.sql("SELECT * FROM VALUES (1, 'The cats are running in the garden'), (2, 'A cat and the dog'), (3, '') AS t(id, x)").select("id", T.to_vector(c("x")).alias("v")).select("id", T.vector_text(c("v")).alias("v"), T.matches(c("v"), T.parse("cat & dog")).alias("has_all"), T.matches(c("v"), T.parse("cats | bird")).alias("has_any"), T.matches(c("v"), T.parse("cat <3> dog")).alias("near"), F.round(T.rank(c("v"), T.parse("cat")), 6).alias("rank")),
    "SELECT * FROM (VALUES (1, '''cat'':2 ''garden'':7 ''run'':4', false, true, false, 0.060793), (2, '''cat'':2 ''dog'':5', true, true, true, 0.060793), (3, '', false, false, false, 0.0)) t(id, v, has_all, has_any, near, rank)",
)
