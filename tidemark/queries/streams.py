"""Streaming queries, drained over the files that are there, against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import operators as S
from .registry import Registry, read

REGISTRY = Registry()
frame = REGISTRY.frame


def stream(s, d):
    return S.file_stream(s, d, read(s, d, "events").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


frame("st_tumbling", lambda s, d: ntz(S.drain(S.tumbling(stream(s, d), "ts", "1 hour", "2 hours", "event_type")), "start").withColumn("total", F.round("total", 4)), "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
frame("st_sliding", lambda s, d: ntz(S.drain(S.sliding(stream(s, d), "ts", "1 hour", "30 minutes", "2 hours")), "start"), "SELECT w AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) x GROUP BY 1")
frame(
    "st_session",
    lambda s, d: ntz(S.drain(S.sessions(stream(s, d), "ts", "2 hours", "3 hours", "user_id")), "start", "end"),
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, g""",
)
frame("st_dedup", lambda s, d: S.drain(S.deduplicated(stream(s, d), "ts", "3650 days", "user_id", "event_type"), "append").select("user_id", "event_type"), "SELECT DISTINCT user_id, event_type FROM events")


def joined(s, d):
    a = stream(s, d).filter("event_type = 'click'").select("user_id", F.col("ts").alias("t1"), F.col("event_id").alias("e1"))
    b = stream(s, d).filter("event_type <> 'click'").select(F.col("user_id").alias("u2"), F.col("ts").alias("t2"), F.col("event_id").alias("e2"))
    return S.drain(S.interval_join(a, b, F.col("user_id") == F.col("u2"), "t1", "t2", "6 HOURS", "3650 days"), "append").select("e1", "e2")


frame("st_interval_join", joined, "SELECT a.event_id AS e1, b.event_id AS e2 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type <> 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR")


def scd2(s, d):
    """A table of periods that a stream of new orders closes out."""
    old = read(s, d, "orders").filter("o_orderdate < '1999-01-01'")
    w = "lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
    current = old.selectExpr("o_custkey AS key", "o_orderdate AS lo", f"{w} AS hi")
    new = S.file_stream(s, d, read(s, d, "orders").schema, "orders.parquet").filter("o_orderdate >= '1999-01-01'").selectExpr("o_custkey AS key", "o_orderdate AS at")
    return S.close_out(new, current, "key", "at", f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark_scd2_{uuid.uuid4().hex}")


frame("st_scd2", scd2, "SELECT key, lo, hi FROM orders_valid")
