"""Reading and writing tables: text formats with database rules, and parquet layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def copy_from(
    spark: SparkSession, path: str, schema: str, fmt: str = "csv", delimiter: str = ",", header: bool = False, null: str = "", quote: str = '"', escape: str = '"', on_error: str = "stop", where: str | None = None, force_null: tuple[str, ...] = ()
) -> DataFrame:
    """COPY FROM: csv or text, malformed rows stop the read or are dropped."""
    opts = {"sep": delimiter if fmt == "csv" else "\t", "header": header, "nullValue": null if fmt == "csv" else "\\N", "emptyValue": "", "quote": quote if fmt == "csv" else "\u0000", "escape": escape, "mode": {"stop": "FAILFAST", "ignore": "DROPMALFORMED"}[on_error], "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}
    df = spark.read.schema(schema).options(**opts).csv(path)
    for c in force_null:
        df = df.withColumn(c, F.when(F.col(c).cast("string") != null, F.col(c)))
    return df.filter(where) if where else df


def copy_to(df: DataFrame, path: str, fmt: str = "csv", delimiter: str = ",", header: bool = False, null: str = "", quote_all: bool = False) -> None:
    """COPY TO, of a table or a query; the text format's values hold no tab or line end."""
    out = df.write.mode("overwrite").options(sep=delimiter if fmt == "csv" else "\t", header=header, quote='"' if fmt == "csv" else "\u0000", nullValue=null if fmt == "csv" else "\\N", quoteAll=quote_all, escape='"', emptyValue='""', timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    out.csv(path)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A remote query through JDBC; filters, projections, aggregates and limits are pushed down."""
    return spark.read.format("jdbc").options(url=url, query=query, pushDownPredicate="true", pushDownAggregate="true", pushDownLimit="true", **options).load()
