"""An index of pages over a table of periods: files with their bounding boxes, scanned only where a query's box can match.

A page is one parquet file; the page table has a row per file with the box of
its rows and whether they are current, history or both. Building and inserting
write files and add their rows to the page table; a scan asks the page table
first and reads the files that are left; deleting writes anew only the pages
that hold rows to delete. The page table is small against the rows (a row per
file) and is itself a table, so nothing of it needs to fit in the driver but
the names of the files that one scan reads.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.periods import BOX_OPERATORS
from . import layouts

#: The largest time and the least and largest attribute by which widths are normalised, and the share of time at which rows without end count as ending.
TIME_MAX, ATTR_MIN, ATTR_MAX, CURRENT_SHARE = 2**63 - 1, 1, 100, 0.9
#: Cost of a page read at random, of a row and of a condition on it, and the factor by which a forced path is cheaper.
PAGE_COST, ROW_COST, CONDITION_COST, FORCED = 4.0, 0.005, 0.0025, 0.05


# Boxes as (attr_lo, attr_hi, t_lo, t_hi) with times in microseconds and None for no end.
@dataclass(frozen=True)
class Box:
    attr_lo: int
    attr_hi: int
    t_lo: int
    t_hi: int | None

    def union(self, other: Box) -> Box:
        end = None if self.t_hi is None or other.t_hi is None else max(self.t_hi, other.t_hi)
        return Box(min(self.attr_lo, other.attr_lo), max(self.attr_hi, other.attr_hi), min(self.t_lo, other.t_lo), end)

    def area(self) -> float:
        end = self.t_hi if self.t_hi is not None else max(int(TIME_MAX * CURRENT_SHARE), self.t_lo + 1)
        wide = min(1.0, max(0.0, (self.attr_hi - self.attr_lo - ATTR_MIN) / (ATTR_MAX - ATTR_MIN)))
        return max(end - self.t_lo, 0) / TIME_MAX * wide


def penalty(page: Box, new: Box) -> float:
    """What a page's area grows by to hold a box: half of it if both are current, twice if only one is."""
    grown = page.union(new).area() - page.area()
    current = (page.t_hi is None, new.t_hi is None)
    return grown * (0.5 if all(current) else 2.0 if any(current) else 1.0)


def kind(boxes: list[Box]) -> str:
    still = sum(b.t_hi is None for b in boxes)
    return "CURRENT" if still == len(boxes) else "HISTORY" if not still else "MIXED"


def pick_split(boxes: list[Box]) -> tuple[list[int], list[int]]:
    """Positions of the two pages that an overfull one becomes.

    Current rows part at the middle between their first and last start. Others: of time and attribute, the
    one in which two boxes are farthest apart gives the seeds, and each box goes where its penalty is less.
    """
    n = len(boxes)
    if n < 2:
        return list(range(n)), []
    if kind(boxes) == "CURRENT":
        starts = [b.t_lo for b in boxes]
        middle = (min(starts) + max(starts)) // 2
        left = [i for i in range(n) if starts[i] <= middle]
        right = [i for i in range(n) if starts[i] > middle]
        return (left, right) if right else (left[:-1], left[-1:])
    spans = [([b.t_lo for b in boxes], [b.t_lo for b in boxes]), ([b.attr_lo for b in boxes], [b.attr_hi for b in boxes])]
    low, high = max(spans, key=lambda s: max(s[1]) - min(s[0]))
    a, b = low.index(min(low)), high.index(max(high))
    b = b if a != b else (a + 1) % n
    sides, unions = ([a], [b]), [boxes[a], boxes[b]]
    for i in range(n):
        if i not in (a, b):
            side = 0 if penalty(unions[0], boxes[i]) < penalty(unions[1], boxes[i]) else 1
            sides[side].append(i)
            unions[side] = unions[side].union(boxes[i])
    return sides


class PageIndex:
    """Rows (attr, lo, hi and others) in pages under a folder, with their page table and counters of what scans did."""

    def __init__(self, spark: SparkSession, path: str, force: bool = False):
        """force: scans go by pages however much of the table matches."""
        self.spark, self.path, self.force = spark, path.rstrip("/"), force
        self.stats: Counter = Counter()

    def _version(self) -> int:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pages-*/_SUCCESS")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)
        return max((int(f.getPath().getParent().getName().rsplit("-", 1)[1]) for f in found or []), default=-1)

    def pages(self) -> DataFrame:
        """(page, rows, attr_lo, attr_hi, t_lo, t_hi, kind)."""
        return self.spark.read.parquet(f"{self.path}/pages-{self._version()}")

    def _boxes(self, folder: str) -> DataFrame:
        rows = self.spark.read.parquet(folder).withColumn("page", F.col("_metadata.file_path"))
        return rows.groupBy("page").agg(
            F.count("*").alias("rows"), F.min("attr").alias("attr_lo"), F.max("attr").alias("attr_hi"), F.min("lo").alias("t_lo"), F.when(F.count("hi") == F.count("*"), F.max("hi")).alias("t_hi"),
            F.when(F.count("hi") == 0, "CURRENT").when(F.count("hi") == F.count("*"), "HISTORY").otherwise("MIXED").alias("kind"),
        )

    def _commit(self, pages: DataFrame) -> None:
        """The next version of the page table; readers of the one before keep its files."""
        pages.write.parquet(f"{self.path}/pages-{self._version() + 1}")

    def build(self, rows: DataFrame, partitions: int = 8) -> None:
        """Pages of current rows and of history by length, each by attribute and start."""
        self.insert(rows, partitions)

    def insert(self, rows: DataFrame, partitions: int = 1) -> None:
        """New rows as pages of their own, packed like those of a build."""
        folder = f"{self.path}/rows-{uuid.uuid4().hex[:12]}"
        layouts.write_layout(rows, folder, "temporal_rtree", partitions)
        made = self._boxes(folder)
        self._commit(self.pages().unionByName(made) if self._version() >= 0 else made)
        self.stats["inserts"] += 1

    def _matching(self, a: Column, b: Column, attr: int, operator: str) -> DataFrame:
        """Pages whose box may hold a row for the operator."""
        pages = self.pages().filter((F.col("attr_lo") <= attr) & (F.col("attr_hi") >= attr))
        ends = lambda t: F.col("t_hi").isNull() | (F.col("t_hi") >= t)
        if operator == "<@":
            return pages.filter((F.col("t_lo") <= b) & ends(a) & (F.col("kind") != "CURRENT"))
        return pages.filter((F.col("t_lo") <= (b if operator == "&&" else a)) & ends(a if operator == "&&" else b))

    def estimate(self, a: Column, b: Column, attr: int, operator: str = "&&") -> dict[str, float]:
        """Pages and rows that a scan would read, and its cost; forced scans count a twentieth."""
        found = self._matching(a, b, attr, operator).agg(F.count("*").alias("pages"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        cost = max(found["pages"], 1) * PAGE_COST + found["rows"] * (ROW_COST + CONDITION_COST)
        return {"pages": found["pages"], "rows": found["rows"], "cost": cost * (FORCED if self.force else 1)}

    def scan(self, a: Column, b: Column, attr: int, operator: str = "&&") -> DataFrame:
        """Rows whose closed box overlaps (&&), contains (@>) or lies in (<@) that of attr and [a, b]."""
        every = self.pages()
        total = every.agg(F.count("*")).first()[0]
        files = [r["page"] for r in self._matching(a, b, attr, operator).select("page").collect()]
        self.stats.update(scans=1, pages_read=len(files), pages_skipped=total - len(files), forced=int(self.force))
        if not files:
            first = every.select("page").first()["page"]
            return self.spark.read.parquet(first).drop(*layouts.ADDED).limit(0)
        return self.spark.read.parquet(*files).drop(*layouts.ADDED).filter(BOX_OPERATORS[operator]("attr", "lo", "hi", F.lit(attr), a, b))

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*[r["page"] for r in self.pages().select("page").collect()]).drop(*layouts.ADDED)

    def bulk_delete(self, which: Column) -> int:
        """Deletes rows; pages that hold some are written anew with their boxes, others stay. How many pages that were."""
        files = [r["page"] for r in self.pages().select("page").collect()]
        hit = self.spark.read.parquet(*files).withColumn("page", F.col("_metadata.file_path")).filter(F.coalesce(which, F.lit(False))).select("page").distinct()
        gone = [r["page"] for r in hit.collect()]
        if not gone:
            return 0
        left = self.spark.read.parquet(*gone).drop(*layouts.ADDED).filter(~F.coalesce(which, F.lit(False)))
        folder = f"{self.path}/rows-{uuid.uuid4().hex[:12]}"
        layouts.write_layout(left, folder, "temporal_rtree", max(1, len(gone) // 2))
        kept = self.pages().filter(~F.col("page").isin(gone))
        self._commit(kept.unionByName(self._boxes(folder)) if not left.isEmpty() else kept)
        self.stats["deletes"] += 1
        return len(gone)

    def reset_stats(self) -> None:
        self.stats.clear()
