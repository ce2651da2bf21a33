"""Constraints, enums, sequences, prepared statements and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys (without nulls) that occur more than once; counted with map-side combining."""
    some = df
    for k in key:
        some = some.filter(F.col(k).isNotNull())
    return some.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a CHECK is false; unknown passes."""
    return df.filter(~F.coalesce(condition, F.lit(True)))


def not_null_violations(df: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)


def foreign_key_violations(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias("__p")), F.col(column) == F.col("__p"), "left_anti")


def enum_rank(value: Column, labels: list[str]) -> Column:
    """Declaration order of an enum's labels, for comparing and sorting."""
    return F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])[value]


def enum_range(labels: list[str], first: str | None = None, last: str | None = None) -> list[str]:
    a = labels.index(first) if first else 0
    b = labels.index(last) + 1 if last else len(labels)
    return labels[a:b]


def numbered(df: DataFrame, order: list[Column], name: str = "nextval", start: int = 1) -> DataFrame:
    """A gapless sequence in a total order, without a single-task window over the rows.

    Rows are range-partitioned and sorted; each partition's numbers start where the counts of those
    before it end. The offsets are a table of one row per partition, joined back.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    return placed.join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__from") + F.col("__i") + start).cast("long")).drop("__p", "__i", "__from")


class Prepared:
    """PREPARE and EXECUTE: named parameters are bound as literals."""

    def __init__(self, spark: SparkSession, sql: str):
        self.spark, self.sql = spark, sql

    def execute(self, **values) -> DataFrame:
        return self.spark.sql(self.sql, args=values)


def refresh_concurrently(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What a refresh changes in a stored result with a unique key: rows to add, to replace (their new values) and to drop."""
    add, gone = new.exceptAll(old), old.exceptAll(new)
    replaced = add.join(gone.select(*key), key, "left_semi")
    added = add.join(gone.select(*key), key, "left_anti")
    dropped = gone.join(add.select(*key), key, "left_anti")
    return added.withColumn("change", F.lit("add")).unionByName(replaced.withColumn("change", F.lit("replace"))).unionByName(dropped.withColumn("change", F.lit("drop")))


def with_ordinality(values: list, spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([(v, i + 1) for i, v in enumerate(values)], schema)
