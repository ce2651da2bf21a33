"""A registry of named queries over the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Tables of periods, derived alike by Spark and by the checking SQL.
DERIVED = {
    "orders_valid": """SELECT o_orderkey AS id, o_custkey AS key, (o_custkey % 100 + 1)::INT AS attr, o_totalprice AS price,
        o_orderdate AS lo, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS hi FROM orders""",
    "events_valid": """SELECT event_id AS id, user_id AS key, (user_id % 100 + 1)::INT AS attr, event_type, value,
        ts AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi FROM events""",
    "supplier_years": """SELECT l_suppkey * 10000 + year(l_shipdate) AS id, l_suppkey AS key, min(l_shipdate) AS lo, max(l_shipdate) AS hi
        FROM lineitem GROUP BY l_suppkey, year(l_shipdate)""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in DERIVED:
        sql = DERIVED[name]
        views(spark, sf_dir, sql)
        return spark.sql(sql)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that sql names."""
    for name in (*TABLES, *DERIVED):
        if re.search(rf"\b{name}\b", sql):
            read(spark, sf_dir, name).createOrReplaceTempView(name)


def with_derived(sql: str) -> str:
    """The checking SQL, with the derived tables it names in front."""
    needed = [f"{n} AS ({DERIVED[n]})" for n in DERIVED if re.search(rf"\b{n}\b", sql)]
    if not needed:
        return sql
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if head:
        return f"WITH {head[1] or ''}{', '.join(needed)}, {sql[head.end() :]}"
    return f"WITH {', '.join(needed)} {sql}"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def frame(self, name: str, query: Query, sql: str | None = None) -> None:
        """A DataFrame query, and its checking SQL."""
        self.queries[name] = query
        if sql:
            self.sql[name] = with_derived(sql)

    def same(self, name: str, sql: str) -> None:
        """One SQL text that both engines run."""
        self.pair(name, sql, sql)

    def pair(self, name: str, spark_sql: str, sql: str | None) -> None:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, spark_sql)
            return spark.sql(spark_sql)

        self.frame(name, query, sql)
