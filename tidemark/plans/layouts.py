"""Physical designs of a table of periods, and what each lets a query skip.

Each design stands for one way to index such a table. What an index finds,
folders and the statistics of files and row groups rule out here: rows that
a query wants together are written together. Parquet's statistics of timestamps
without zone are not used by Spark's reader, so each design but the first
also keeps both bounds as microseconds, which are.

  no_index                 as it comes
  btree                    sorted by attribute and start
  brin                     sorted by start: block ranges of it are narrow
  gist_period              by class of length, then start: both bounds are narrow
  gist_attr_period         by attribute, class of length and start
  hst_gist                 history apart from current rows, by class of length and start
  hybrid_current_history   current rows by attribute and start, history as hst_gist
  temporal_rtree           current rows, history and their boxes: attribute, class of length, start
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Columns that a layout adds.
ADDED = ("is_current", "length_class", "lo_us", "hi_us")


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)


def length_class() -> Column:
    """Periods of like length: the number of fourfold steps from a day; -1 without end."""
    days = F.timestamp_diff("MICROSECOND", F.col("lo"), F.col("hi")) / DAY_US
    return F.when(F.col("hi").isNull(), -1).otherwise(F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(days, F.lit(1.0)))))).cast("int")


#: Folders, then the order of rows within them.
LAYOUTS: dict[str, tuple[list[str], list[str]]] = {
    "no_index": ([], []),
    "btree": ([], ["attr", "lo"]),
    "brin": ([], ["lo"]),
    "gist_period": (["length_class"], ["lo"]),
    "gist_attr_period": (["length_class"], ["attr", "lo"]),
    "hst_gist": (["is_current", "length_class"], ["lo"]),
    "hybrid_current_history": (["is_current"], ["attr_if_current", "lo"]),
    "temporal_rtree": (["is_current", "length_class"], ["attr", "lo"]),
}


def shaped(df: DataFrame, layout: str) -> DataFrame:
    """df with the columns that the layout's folders and order need."""
    folders, order = LAYOUTS[layout]
    made = {"is_current": F.col("hi").isNull(), "length_class": length_class(), "lo_us": micros(F.col("lo")), "hi_us": micros(F.col("hi"))}
    return df.withColumns({c: made[c] for c in (*folders, *(("lo_us", "hi_us") if order else ()))})


def write_layout(df: DataFrame, path: str, layout: str, partitions: int = 8, row_group_bytes: int | None = None, mode: str = "overwrite") -> None:
    """Write a table of periods (attr, lo, hi and others) in a layout, over about `partitions` files."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}")
    folders, order = LAYOUTS[layout]
    rows = shaped(df, layout)
    keys = [F.col(c) for c in folders] + [F.when(F.col("hi").isNull(), F.col("attr")) if c == "attr_if_current" else F.col(c) for c in order]
    if keys:
        rows = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    out = rows.write.mode(mode).partitionBy(*folders) if folders else rows.write.mode(mode)
    if row_group_bytes:
        out = out.option("parquet.block.size", str(row_group_bytes))
    out.option("parquet.bloom.filter.enabled#attr", "true").option("parquet.bloom.filter.expected.ndv#attr", "1000").parquet(path)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*ADDED)


def overlapping(spark: SparkSession, path: str, layout: str, a: Column, b: Column, attr: int | None = None) -> DataFrame:
    """Rows of a written layout whose period overlaps [a, b); with attr, whose closed box touches that of attr and [a, b].

    History and current rows are branches of their own where the layout keeps them apart, and a period that
    ends after a cannot start before a less the longest period of its length class, which bounds both sides of lo.
    """
    df = spark.read.parquet(path)
    folders, _ = LAYOUTS[layout]
    closed = attr is not None
    over = lambda x, y: x >= y if closed else x > y
    under = lambda x, y: x <= y if closed else x < y
    hit = under(F.col("lo"), b) & (F.col("hi").isNull() | over(F.col("hi"), a))
    if "lo_us" in df.columns:
        hit = hit & under(F.col("lo_us"), micros(b)) & (F.col("hi_us").isNull() | over(F.col("hi_us"), micros(a)))
    hit = hit & (F.col("attr") == attr if closed else F.col("hi").isNull() | (F.col("hi") > F.col("lo")))
    if "length_class" in folders:
        classes = sorted(r[0] for r in df.select("length_class").distinct().collect())
        within = F.lit(False)
        for n in classes:
            within = within | ((F.col("length_class") == n) & (F.lit(True) if n < 0 else F.col("lo_us") >= micros(a) - (4**n + 1) * DAY_US))
        hit = hit & within
    return df.filter(hit).drop(*ADDED)


def layout_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, rows, current_rows) of a written layout."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("size"), F.col("hi").isNull().alias("current"))
    by_file = rows.groupBy("f", "size").agg(F.count("*").alias("n"), F.count_if("current").alias("c"))
    return by_file.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("n").alias("rows"), F.sum("c").alias("current_rows"))


def rows_scanned(df: DataFrame) -> int:
    """Runs df, a small result, and counts the rows that its scans gave out: what folders and statistics could not skip."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total
