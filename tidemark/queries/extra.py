"""Further text, network, search and time functions, recursion with paths, and change capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc as M
from ..functions import phonetic as H
from ..functions import search as T
from ..functions import text as X
from ..streaming import operators as S
from .registry import Registry, read

REGISTRY = Registry()
frame, same, pair = REGISTRY.frame, REGISTRY.same, REGISTRY.pair
c = F.col

frame("e_format", lambda s, d: read(s, d, "nation").select("n_nationkey", X.format_sql("%s-%I-%L-%%", c("n_nationkey"), F.lower(c("n_name")), F.nullif(c("n_regionkey"), F.lit(1))).alias("f")), "SELECT n_nationkey, n_nationkey || '-' || CASE WHEN regexp_matches(lower(n_name), '^[a-z_][a-z0-9_$]*$') THEN lower(n_name) ELSE '\"' || lower(n_name) || '\"' END || '-' || coalesce('''' || nullif(n_regionkey, 1) || '''', 'NULL') || '-%' AS f FROM nation")
frame("e_input_is_valid", lambda s, d: s.sql("SELECT explode(array('1', 'x', '2020-02-30', '2020-02-28')) AS v").select("v", X.input_is_valid(c("v"), "int").alias("i"), X.input_is_valid(c("v"), "date").alias("d")), "SELECT * FROM (VALUES ('1', true, false), ('x', false, false), ('2020-02-30', false, false), ('2020-02-28', false, true)) t(v, i, d)")
frame("e_regexp_substr", lambda s, d: read(s, d, "part").select("p_partkey", X.regexp_substr(c("p_brand"), "[0-9]", 2).alias("b"), F.regexp_instr("p_brand", F.lit("[0-9]")).alias("i")), "SELECT p_partkey, regexp_extract_all(p_brand, '[0-9]')[2] AS b, strpos(p_brand, regexp_extract(p_brand, '[0-9]'))::INT AS i FROM part")
frame("e_like_escape", lambda s, d: s.sql("SELECT explode(array('a%b', 'axb')) AS v").select("v", X.like_with_escape(c("v"), "a!%b", "!").alias("m")), "SELECT v, v LIKE 'a!%b' ESCAPE '!' AS m FROM (VALUES ('a%b'), ('axb')) t(v)")
frame("e_bits", lambda s, d: read(s, d, "nation").select("n_nationkey", X.bits(c("n_nationkey"), 8).alias("b")), "SELECT n_nationkey, lpad(bin(n_nationkey), 8, '0') AS b FROM nation")
frame(
    "e_metaphone",
    lambda s, d: s.sql("SELECT explode(array('Gumbo', 'Phone', 'Church', 'gem', 'Knight', 'Xavier', 'nation', 'dodge', 'school', 'whistle', 'comb', 'thumb')) AS v").select("v", H.metaphone("v").alias("m")),
    "SELECT * FROM (VALUES ('Gumbo', 'KMB'), ('Phone', 'FN'), ('Church', 'XRX'), ('gem', 'JM'), ('Knight', 'NT'), ('Xavier', 'SFR'), ('nation', 'NXN'), ('dodge', 'TJ'), ('school', 'SKL'), ('whistle', 'WSTL'), ('comb', 'KM'), ('thumb', '0M')) t(v, m)",
)
frame("e_normalize", lambda s, d: s.sql("SELECT 'e\\u0301a' AS v").select(F.length(H.normalize_nfc("v")).alias("c"), F.length(H.normalize_nfd("v")).alias("d"), H.unicode_assigned("v").alias("a")), "SELECT 2 AS c, 3 AS d, true AS a")
frame("e_inet_more", lambda s, d: read(s, d, "nation").select("n_nationkey", F.concat(F.lit("10.0.0."), c("n_nationkey").cast("string"), F.lit("/28")).alias("a")).select("n_nationkey", M.hostmask(c("a")).alias("h"), M.inet_merge(c("a"), F.lit("10.0.0.3/28")).alias("m")), "SELECT n_nationkey, '0.0.0.15' AS h, CASE WHEN n_nationkey < 16 THEN '10.0.0.0/28' ELSE '10.0.0.0/27' END AS m FROM nation")
frame("e_macaddr", lambda s, d: s.sql("SELECT '12:34:56:78:9a:bc' AS m").select(M.macaddr_trunc(c("m")).alias("t")), "SELECT '12:34:56:00:00:00' AS t")
frame("e_lca", lambda s, d: s.sql("SELECT * FROM VALUES ('a.b.c', 'a.b.d'), ('a.b', 'a.b.d'), ('a', 'b') AS t(x, y)").select("x", M.common_ancestor(c("x"), c("y")).alias("l")), "SELECT * FROM (VALUES ('a.b.c', 'a.b'), ('a.b', 'a'), ('a', '')) t(x, l)")
frame(
    "e_headline",
    lambda s, d: read(s, d, "nation").select("n_nationkey", F.concat(F.lit("The "), F.lower("n_name"), F.lit(" runs, cat-like (c++)")).alias("t")).select(
        "n_nationkey", T.headline(c("t"), T.parse("running & cat")).alias("h"), T.matches(T.to_vector(c("t")), T.websearch('"run cat" -dog or bird')).alias("w"), T.matches(T.to_vector(c("t")), T.websearch("run -like")).alias("x")
    ),
    "SELECT n_nationkey, 'The ' || lower(n_name) || ' <b>runs</b>, <b>cat</b>-like (c++)' AS h, false AS w, false AS x FROM nation",
)
frame(
    "e_search_rank",
    lambda s, d: read(s, d, "part").select("p_partkey", T.to_vector(F.concat_ws(" ", "p_name", "p_name", "p_type")).alias("v"), F.split("p_name", "[^A-Za-z0-9]+").alias("w")).select(
        "p_partkey", F.array_contains(T.lexemes_of(c("v")), F.lit("zebra")).alias("z"), T.matches(c("v"), T.parse("part:* | blue")).alias("m"), F.round(T.rank(T.to_vector(F.lit("cat dog cat")), T.parse("cat")), 9).alias("r")
    ),
    f"SELECT p_partkey, false AS z, regexp_matches(lower(p_name || ' ' || p_type), '\\b(part[a-z0-9]*|blue)\\b') AS m, round((0.1 + 0.1 + 0.1 / 4 - 0.1) / 1.64493406685, 9)::DOUBLE AS r FROM part",
)
frame("e_age", lambda s, d: s.sql("SELECT DATE'2021-05-20' AS a, DATE'2019-12-25' AS b").select(M.age(c("a"), c("b")).alias("g"), M.justify_days(F.lit(1), F.lit(65)).alias("j")).select("g.*", c("j.months").alias("jm"), c("j.days").alias("jd")), "SELECT 1 AS years, 4 AS months, 25 AS days, 3 AS jm, 5 AS jd")
frame("e_seg", lambda s, d: read(s, d, "part").select("p_partkey", M.segments_overlap(c("p_size") - 1.5, c("p_size") + 1.5, F.lit(10.0), F.lit(12.0)).alias("o")), "SELECT p_partkey, p_size - 1.5 <= 12 AND 10 <= p_size + 1.5 AS o FROM part")

# Recursion with SEARCH and CYCLE: the path is carried as an array.
pair(
    "e_search_cycle",
    "WITH RECURSIVE t(n, path, cycled) AS (SELECT 1, array(1), false UNION ALL SELECT m, concat(path, array(m)), array_contains(path, m) FROM (SELECT path, cycled, (n * 3) % 7 AS m FROM t) x WHERE NOT cycled) SELECT n, array_join(path, '>') AS path, cycled FROM t",
    "WITH RECURSIVE t(n, path, cycled) AS (SELECT 1, [1], false UNION ALL SELECT m, list_append(path, m), list_contains(path, m) FROM (SELECT path, cycled, (n * 3) % 7 AS m FROM t) x WHERE NOT cycled) SELECT n, array_to_string(path, '>') AS path, cycled FROM t",
)


def returning(s, d):
    """UPDATE ... RETURNING: the rows that change, old and new value."""
    rows = read(s, d, "customer").withColumn("new", F.when(c("c_acctbal") < 0, F.lit(0.0)).otherwise(c("c_acctbal")))
    return rows.filter(c("new") != c("c_acctbal")).select("c_custkey", c("c_acctbal").alias("old"), "new")


frame("e_returning", returning, "SELECT c_custkey, c_acctbal AS old, 0.0::DOUBLE AS new FROM customer WHERE c_acctbal < 0")


def changes(s, d):
    """Change capture between two states of a table: inserts, updates and deletes by key."""
    old = read(s, d, "nation").filter("n_nationkey < 20").select(c("n_nationkey").alias("k"), c("n_name").alias("v"))
    new = read(s, d, "nation").filter("n_nationkey > 4").select(c("n_nationkey").alias("k"), F.when(c("n_regionkey") == 2, F.lower("n_name")).otherwise(c("n_name")).alias("v"))
    both = old.alias("o").join(new.alias("n"), "k", "full")
    kind = F.when(c("o.v").isNull(), "insert").when(c("n.v").isNull(), "delete").when(c("o.v") != c("n.v"), "update")
    return both.select("k", kind.alias("op"), c("o.v").alias("before"), c("n.v").alias("after")).filter("op IS NOT NULL")


frame("e_change_capture", changes, "SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.v IS NULL THEN 'insert' WHEN n.v IS NULL THEN 'delete' ELSE 'update' END AS op, o.v AS before, n.v AS after FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 20) o FULL JOIN (SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_nationkey > 4) n ON o.k = n.k WHERE o.v IS DISTINCT FROM n.v")


def published(s, d):
    """A publication: row filter and column list over a stream."""
    rows = S.file_stream(s, d, read(s, d, "events").schema, "events.parquet")
    return S.drain(rows.filter("event_type = 'click' AND value > 10").select("event_id", "user_id"), "append")


frame("e_publication", published, "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 10")


def batches(s, d):
    """A statement trigger with its transition table: each micro-batch as a view, summed into a log."""
    log: list[tuple[int, int]] = []

    def on_batch(batch, number: int) -> None:
        batch.createOrReplaceTempView("new_rows")
        log.append((number, batch.sparkSession.sql("SELECT count(*) AS n FROM new_rows").first()["n"]))

    rows = S.file_stream(s, d, read(s, d, "events").schema, "events.parquet")
    rows.writeStream.foreachBatch(on_batch).trigger(availableNow=True).start().awaitTermination()
    return s.createDataFrame([(sum(n for _, n in log),)], "n long")


frame("e_transition_table", batches, "SELECT count(*) AS n FROM events")
