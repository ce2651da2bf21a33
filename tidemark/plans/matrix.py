"""The temporal workload over every physical layout: a select, an insert, an update and a delete, timed.

Changes are copies on write: an insert appends files in the layout, an update
or a delete writes the table anew.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal as T
from . import generator, layouts

#: Layouts whose select is by boxes of attribute and time.
BOXES = ("gist_attr_period", "temporal_rtree")
ATTR, INSERTED = 10, 10_000


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def select(spark: SparkSession, path: str, layout: str) -> DataFrame:
    found = layouts.overlapping(spark, path, layout, ts("2023-01-01"), ts("2023-06-01"), ATTR if layout in BOXES else None)
    return found.agg(F.count("*").alias("n"))


def new_rows(spark: SparkSession, after: int) -> DataFrame:
    """Rows that start on 2024-01-01 and last 1 to 101 days, of any attribute."""
    rows = spark.range(after + 1, after + 1 + INSERTED)
    days = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (generator.unit(1, 2) * 100 + 1) * 86_400)
    return rows.select("id", generator.between(generator.unit(1, 1), 0, 100).alias("attr"), ts("2024-01-01").alias("lo"), (ts("2024-01-01") + days).alias("hi"), F.md5(F.col("id").cast("string").cast("binary")).alias("payload"))


def updated(rows: DataFrame) -> DataFrame:
    return T.close_current(rows, F.col("attr").between(1, 10) & (F.col("lo") < ts("2030-12-31")), ts("2030-12-31"))


def deleted(rows: DataFrame) -> DataFrame:
    return T.delete_history(rows, ts("2020-01-01"), ts("2021-01-01"))


def run(spark: SparkSession, folder: str, rows: int = 100_000, preset: str = "balanced") -> dict[str, float]:
    """Seconds of each statement by layout, the tables being written before the clock starts."""
    took: dict[str, float] = {}

    def timed(name: str, fn: Callable[[], object]) -> None:
        start = time.time()
        fn()
        took[name] = round(time.time() - start, 3)

    data = generator.generate(spark, rows, preset)
    for layout in layouts.LAYOUTS:
        path = f"{folder}/{layout}"
        layouts.write_layout(data, path, layout)
        select(spark, path, layout).collect()
        timed(f"{layout}_select", lambda p=path, x=layout: select(spark, p, x).collect())
        timed(f"{layout}_insert", lambda p=path, x=layout: layouts.write_layout(new_rows(spark, rows), p, x, mode="append"))
        timed(f"{layout}_update", lambda p=path, x=layout: layouts.write_layout(updated(layouts.read_layout(spark, p)), f"{p}_updated", x))
        timed(f"{layout}_delete", lambda p=path, x=layout: layouts.write_layout(deleted(layouts.read_layout(spark, p)), f"{p}_deleted", x))
    return took
