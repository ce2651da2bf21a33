"""JSON paths, integer arrays, constraints, user-defined functions, XML, crypto, money, stored results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import intarray as I
from ..functions import json as J
from ..functions import jsonpath as JP
from ..operators import catalog as C
from .registry import Registry, read

REGISTRY = Registry()
frame, same, pair = REGISTRY.frame, REGISTRY.same, REGISTRY.pair
c = F.col


def docs(s, d):
    """One JSON document per nation: numbers, a null, an array of objects."""
    items = F.concat(F.lit('[{"q":'), c("n_nationkey").cast("string"), F.lit(',"ok":true},{"q":50}]'))
    return read(s, d, "nation").select("n_nationkey", F.concat(F.lit('{"id":'), c("n_nationkey").cast("string"), F.lit(',"name":"'), c("n_name"), F.lit('","gone":null,"items":'), items, F.lit("}")).alias("doc"))


frame("x_json_exists", lambda s, d: docs(s, d).select("n_nationkey", J.exists_key(c("doc"), "id").alias("a"), J.exists_any(c("doc"), "zz", "name").alias("b"), J.exists_all(c("doc"), "id", "zz").alias("k")), "SELECT n_nationkey, true AS a, true AS b, false AS k FROM nation")
frame("x_json_contains", lambda s, d: docs(s, d).select("n_nationkey", J.contains(c("doc"), F.lit('{"id":3}')).alias("k")), "SELECT n_nationkey, n_nationkey = 3 AS k FROM nation")
frame("x_json_edit", lambda s, d: s.sql("""SELECT '{"a":1,"b":"x y","c":null}' AS doc""").select(J.set_key(c("doc"), "a", "[2,3]").alias("s"), J.delete_key(c("doc"), "a").alias("k"), J.strip_nulls(c("doc")).alias("n")), """SELECT '{"a":[2,3],"b":"x y","c":null}' AS s, '{"b":"x y","c":null}' AS k, '{"a":1,"b":"x y"}' AS n""")
frame("x_json_types", lambda s, d: s.sql("SELECT explode(array('1', '\"a\"', '[]', '{}', 'true', 'null', '{x')) AS j").select("j", J.typeof(c("j")).alias("t"), J.is_json(c("j")).alias("ok")), """SELECT * FROM (VALUES ('1', 'number', true), ('"a"', 'string', true), ('[]', 'array', true), ('{}', 'object', true), ('true', 'boolean', true), ('null', 'null', true), ('{x', 'object', false)) v(j, t, ok)""")
ITEM = "struct<q:int,ok:boolean>"
frame(
    "x_jsonpath_filter",
    lambda s, d: docs(s, d).select("n_nationkey", J.value(c("doc"), "$.items[0].q", "int").alias("first"), J.value(c("doc"), "$.name", "string").alias("name"), F.size(J.path_filter(c("doc"), "$.items", ITEM, lambda x: (x.q * 2 > 20) & x.ok)).alias("n"), J.path_exists(c("doc"), "$.items", ITEM, lambda x: x.q == 7).alias("has7"), F.aggregate(J.array_at(c("doc"), "$.items", ITEM), F.lit(0), lambda acc, x: acc + x.q).alias("total")),
    "SELECT n_nationkey, n_nationkey AS first, n_name AS name, (n_nationkey > 10)::INT AS n, n_nationkey = 7 AS has7, n_nationkey + 50 AS total FROM nation",
)
frame(
    "x_jsonpath_language",
    lambda s, d: docs(s, d).select(
        "n_nationkey",
        JP.path_exists(c("doc"), "$.items[*] ? (@.q > $x && @.ok == true)", {"x": 10}).alias("a"),
        JP.path_query_first(c("doc"), "$.**.q ? (@ >= 50)").alias("b"),
        JP.path_match(c("doc"), '$.name starts with "F" || $.name like_regex "an[^a]*$" flag "i"').alias("e"),
        JP.json_value(c("doc"), "$.items.size()").alias("f"),
        JP.path_query_array(c("doc"), "$.items[last, 0].q").alias("g"),
        JP.json_value(c("doc"), "-($.id + 1) * 2 % 7").alias("h"),
        JP.json_value(c("doc"), "$.gone.type()").alias("i"),
        F.size(JP.path_query(c("doc"), "$.keyvalue() ? (@.value != null)")).alias("j"),
        JP.json_value(c("doc"), "$.missing").alias("k"),
        JP.json_query(c("doc"), "$.items[*] ? (!(@.ok == true)).q", wrapper=True).alias("l"),
    ),
    """SELECT n_nationkey, n_nationkey > 10 AS a, CASE WHEN n_nationkey >= 50 THEN n_nationkey ELSE 50 END::VARCHAR AS b, starts_with(n_name, 'F') OR regexp_matches(n_name, 'an[^a]*$', 'i') AS e, '2' AS f,
    '[50, ' || n_nationkey || ']' AS g, (-(n_nationkey + 1) * 2 % 7)::VARCHAR AS h, 'null' AS i, 3 AS j, NULL::VARCHAR AS k, '[50]' AS l FROM nation""",
)
frame(
    "x_jsonb_edit",
    lambda s, d: docs(s, d).select(
        "n_nationkey",
        JP.contains(c("doc"), F.lit('{"items":[{"q":50}]}')).alias("a"),
        JP.contained(F.lit('{"items":[{"q":3}]}'), c("doc")).alias("b"),
        JP.json_value(JP.set_path(c("doc"), ["items", "-1", "q"], "7"), "$.items[1].q").alias("e"),
        JP.json_value(JP.insert_path(c("doc"), ["items", "1"], '"x"'), "$.items[1]").alias("f"),
        JP.canonical(JP.delete_path(JP.strip_nulls(c("doc")), ["items"])).alias("g"),
        JP.compare(JP.path_query_first(c("doc"), "$.id"), F.lit("12")).alias("h"),
        JP.concat(F.lit('{"id": 1}'), JP.path_query_first(c("doc"), "$.items[0]")).alias("i"),
    ),
    """SELECT n_nationkey, true AS a, n_nationkey = 3 AS b, '7' AS e, 'x' AS f, '{"id": ' || n_nationkey || ', "name": "' || n_name || '"}' AS g, sign(n_nationkey - 12)::INT AS h, '{"q": ' || n_nationkey || ', "id": 1, "ok": true}' AS i FROM nation""",
)
frame("x_json_each", lambda s, d: docs(s, d).select("n_nationkey", F.explode(J.members(c("doc"))).alias("key", "value")).select("n_nationkey", "key"), "SELECT n_nationkey, unnest(['id', 'name', 'gone', 'items']) AS key FROM nation")
frame("x_json_object_agg", lambda s, d: read(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))))).alias("j")).select("n_regionkey", F.json_array_length(F.concat(F.lit("["), c("j"), F.lit("]"))).alias("n")), "SELECT n_regionkey, 1 AS n FROM nation GROUP BY n_regionkey")

ARR = "(SELECT array(5, 1, 1, 3, 1) AS a, array(1, 9) AS b)"


def ints(s, d):
    join = lambda x: F.array_join(x, ",")
    a, b = c("a"), c("b")
    return s.sql(f"SELECT * FROM {ARR}").select(I.icount(a).alias("n"), join(I.uniq(a)).alias("u"), I.idx(a, 3).alias("i"), join(I.subarray(a, -2, 2)).alias("s"), join(I.minus(a, b)).alias("m"), join(I.union(a, b)).alias("o"), join(I.intersection(a, b)).alias("x"), I.dims(a).alias("d"), join(I.trim_array(a, 2)).alias("t"), join(I.positions(a, F.lit(1))).alias("p"), join(I.replace(a, F.lit(1), F.lit(0))).alias("r"), I.larger_than_all(F.lit(6), a).alias("g"))


frame("x_intarray", ints, "SELECT 5 AS n, '5,1,3,1' AS u, 4 AS i, '3,1' AS s, '3,5' AS m, '1,3,5,9' AS o, '1' AS x, '[1:5]' AS d, '5,1,1' AS t, '2,3,5' AS p, '5,0,0,3,0' AS r, true AS g")

# Constraints and sequences.
frame("x_unique_violations", lambda s, d: C.unique_violations(read(s, d, "customer"), ["c_nationkey"]), "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey HAVING count(*) > 1")
frame("x_check_violations", lambda s, d: C.check_violations(read(s, d, "customer"), F.nullif(c("c_acctbal"), F.lit(0.0)) > 0).select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0) AND c_acctbal <> 0")
frame("x_foreign_key_violations", lambda s, d: C.foreign_key_violations(read(s, d, "orders"), "o_custkey", read(s, d, "customer").filter("c_acctbal > 0"), "c_custkey").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
frame("x_sequence", lambda s, d: C.numbered(read(s, d, "orders").select("o_orderkey", "o_orderdate"), [c("o_orderdate"), c("o_orderkey")]).select("o_orderkey", "nextval"), "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS nextval FROM orders")
LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
frame("x_enum", lambda s, d: read(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).select("n", C.enum_rank(c("o_orderpriority"), LABELS).alias("r")), "SELECT count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS r FROM orders GROUP BY o_orderpriority")
frame("x_prepared", lambda s, d: (read(s, d, "orders").createOrReplaceTempView("orders"), C.Prepared(s, "SELECT o_orderkey FROM orders WHERE o_custkey = :k AND o_totalprice > :p").execute(k=7, p=1000.0))[1], "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
frame("x_matview_diff", lambda s, d: C.refresh_concurrently(read(s, d, "nation").filter("n_nationkey < 20"), read(s, d, "nation").filter("n_nationkey > 4"), ["n_nationkey"]).select("n_nationkey", "change"), "SELECT n_nationkey, 'add' AS change FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_nationkey, 'drop' FROM nation WHERE n_nationkey <= 4")


# User-defined functions: Arrow batches only.
def scalar_udf(s, d):
    @F.pandas_udf("double")
    def boosted(x: pd.Series) -> pd.Series:
        return x * 1.5

    return read(s, d, "customer").select("c_custkey", F.round(boosted("c_acctbal"), 4).alias("v"))


def aggregate_udf(s, d):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return read(s, d, "customer").groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 4).alias("v"))


def table_function(s, d):
    @F.udtf(returnType="n int, square int")
    class Squares:
        def eval(self, upto: int):
            for i in range(1, upto + 1):
                yield i, i * i

    return Squares(F.lit(5))


def grouped_map(s, d):
    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.nsmallest(1, ["p_size", "p_partkey"])[["p_brand", "p_partkey"]]

    return read(s, d, "part").select("p_brand", "p_partkey", "p_size").groupBy("p_brand").applyInPandas(top, "p_brand string, p_partkey long")


frame("u_scalar", scalar_udf, "SELECT c_custkey, round(c_acctbal * 1.5, 4) AS v FROM customer")
frame("u_aggregate", aggregate_udf, "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS v FROM customer GROUP BY c_nationkey")
frame("u_table", table_function, "SELECT n::INT AS n, (n * n)::INT AS square FROM range(1, 6) t(n)")
frame("u_grouped_map", grouped_map, "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r FROM part) z WHERE r = 1")


def sql_function(s, d):
    read(s, d, "customer").createOrReplaceTempView("customer")
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION banded(x DOUBLE) RETURNS STRING RETURN CASE WHEN x < 0 THEN 'debt' WHEN x < 5000 THEN 'some' ELSE 'much' END")
    return s.sql("SELECT banded(c_acctbal) AS band, count(*) AS n FROM customer GROUP BY 1")


frame("u_sql", sql_function, "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band, count(*) AS n FROM customer GROUP BY 1")

# XML, crypto, money, collation, hashing.
pair("x_xpath", "SELECT n_nationkey, xpath_string(x, 'a/b/@k') AS k, xpath_int(x, 'count(a/c)') AS n, array_join(xpath(x, 'a/c/text()'), ',') AS t FROM (SELECT n_nationkey, concat('<a><b k=\"', n_name, '\"/><c>1</c><c>2</c></a>') AS x FROM nation)", "SELECT n_nationkey, n_name AS k, 2 AS n, '1,2' AS t FROM nation")
pair("x_encrypt", "SELECT n_nationkey, CAST(aes_decrypt(aes_encrypt(n_name, '0123456789abcdef'), '0123456789abcdef') AS STRING) AS n, crc32(n_name) > 0 AS k FROM nation", "SELECT n_nationkey, n_name AS n, true AS k FROM nation")
pair("x_money", "SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(19, 2)) * 2 AS DOUBLE) AS m FROM customer", "SELECT c_custkey, (c_acctbal::DECIMAL(19, 2) * 2)::DOUBLE AS m FROM customer")
pair("x_citext", "SELECT n_nationkey FROM nation WHERE n_name COLLATE UTF8_LCASE = lower(n_name) COLLATE UTF8_LCASE", "SELECT n_nationkey FROM nation")
pair("x_hash_partition", "SELECT sum(n) AS n, min(n) > 0 AS spread FROM (SELECT pmod(hash(o_orderkey), 8) AS p, count(*) AS n FROM orders GROUP BY 1)", "SELECT count(*)::BIGINT AS n, true AS spread FROM orders")
pair("x_intervals", "SELECT n_nationkey, CAST(timestampdiff(HOUR, t, t + make_dt_interval(n_nationkey, 5)) AS BIGINT) AS h, month(add_months(DATE'2020-01-31', n_nationkey)) AS m, CAST(months_between(DATE'2021-03-01', DATE'2020-03-01') AS INT) AS a FROM (SELECT n_nationkey, TIMESTAMP_NTZ'2020-01-01' AS t FROM nation)", "SELECT n_nationkey, n_nationkey * 24 + 5 AS h, n_nationkey % 12 + 1 AS m, 12 AS a FROM nation")
pair("x_number_format", "SELECT n_nationkey, btrim(to_char(n_nationkey * 1234, '999,999')) AS f, to_number('1,234', '9,999') + n_nationkey AS p FROM nation WHERE n_nationkey > 0", "SELECT n_nationkey, format('{:,}', n_nationkey * 1234) AS f, 1234 + n_nationkey AS p FROM nation WHERE n_nationkey > 0")
pair("x_typeof", "SELECT typeof(o_orderkey) AS a, typeof(o_totalprice) AS b, typeof(o_orderdate) AS c, count(*) AS n FROM orders GROUP BY 1, 2, 3", "SELECT 'bigint' AS a, 'double' AS b, 'timestamp_ntz' AS c, count(*) AS n FROM orders GROUP BY 1, 2, 3")


def saved(s, d):
    """CREATE TABLE AS, read back through the catalog."""
    s.sql("DROP TABLE IF EXISTS tidemark_ctas")
    read(s, d, "nation").filter("n_regionkey = 1").write.mode("overwrite").saveAsTable("tidemark_ctas")
    return s.table("tidemark_ctas").select("n_nationkey", "n_name")


frame("x_ctas", saved, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
