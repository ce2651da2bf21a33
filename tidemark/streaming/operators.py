"""Structured Streaming plans: the same windows and periods over a stream of events.

Sources are folders of files with a given schema; results are drained into
files, or any writer. State is bounded by watermarks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tumbling(df: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, at: str, width: str, slide: str, late: str, *by: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, width, slide), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, at: str, gap: str, late: str, *by: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def deduplicated(df: DataFrame, at: str, late: str, *key: str) -> DataFrame:
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(list(key))


def interval_join(left: DataFrame, right: DataFrame, on: Column, left_at: str, right_at: str, within: str, late: str) -> DataFrame:
    """Stream-stream join of rows at most `within` after one another; state is dropped behind the watermarks."""
    a, b = left.withWatermark(left_at, late), right.withWatermark(right_at, late)
    return a.join(b, on & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {within}")))


def upsert_periods(current: DataFrame, batch: DataFrame, key: str, at: str) -> DataFrame:
    """SCD2 close-out of one micro-batch: changed keys' current rows end where the batch's rows start."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("lo")
    rows = current.filter("hi IS NULL").join(batch.select(key).distinct(), key, "left_semi")
    still = current.join(batch.select(key).distinct(), key, "left_anti").unionByName(current.filter("hi IS NOT NULL").join(batch.select(key).distinct(), key, "left_semi"))
    new = batch.select(key, F.col(at).alias("lo"), F.lit(None).cast("timestamp_ntz").alias("hi"), *[c for c in current.columns if c not in (key, "lo", "hi")])
    return still.unionByName(rows.unionByName(new).withColumn("hi", F.lead("lo").over(w)))


def close_out(stream: DataFrame, current: DataFrame, key: str, at: str, folder: str) -> DataFrame:
    """upsert_periods() for every micro-batch of a stream, until it has no more; the table that they leave.

    Batch n reads version n of the table in `folder` and writes version n + 1, so a batch that is run
    again after a failure gives the same version.
    """
    spark = current.sparkSession
    current.write.mode("overwrite").parquet(f"{folder}/version-0")

    def on_batch(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(current.schema).parquet(f"{folder}/version-{number}")
        upsert_periods(before, batch, key, at).write.mode("overwrite").parquet(f"{folder}/version-{number + 1}")

    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    done = last["batchId"] + 1 if last and last["numInputRows"] else max((p["batchId"] + 1 for p in query.recentProgress if p["numInputRows"]), default=0)
    return spark.read.schema(current.schema).parquet(f"{folder}/version-{done}")


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, into files beside the warehouse's tables, and return the result as a table.

    Each batch writes a folder of its own, again if it is run again; in complete mode the last one is the result.
    """
    spark = df.sparkSession
    folder, done = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark_drained_{uuid.uuid4().hex}", []

    def on_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        done.append(f"{folder}/batch-{number}")

    df.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    found = done[-1:] if mode == "complete" else list(dict.fromkeys(done))
    return spark.read.schema(df.schema).parquet(*found) if found else spark.createDataFrame([], df.schema)
