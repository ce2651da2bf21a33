"""Seeded generator of tables of periods, for layouts and benchmarks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2023-01-01"
DAYS = 10 * 365
HOT_ATTRS = 10


@dataclass(frozen=True)
class Preset:
    open_ratio: float
    width: str
    attrs: str
    order: str
    hot_current: float = 0.0


#: The presets' names, shares of open-ended rows, width modes, attribute modes, orders and hot shares.
PRESETS = {
    "history_skew": Preset(0.30, "short", "uniform", "chronological"),
    "current_skew": Preset(0.80, "short", "uniform", "mixed"),
    "balanced": Preset(0.50, "medium", "uniform", "chronological"),
    "long_tailed": Preset(0.30, "long_tailed", "uniform", "mixed"),
    "zipf_uniform": Preset(0.50, "medium", "zipf", "chronological"),
    "zipf_hotcurrent": Preset(0.70, "medium", "zipf", "mixed", 0.15),
}

#: Fixed values: (share of rows up to which it holds, least hours, most hours) by width mode.
WIDTHS = {
    "short": [(1.0, 1, 24)],
    "medium": [(1.0, 24, 365 * 24)],
    "long_tailed": [(0.70, 1, 72), (0.95, 72, 30 * 24), (1.0, 30 * 24, 5 * 365 * 24)],
}


def unit(seed: int, use: int) -> Column:
    """A number in [0, 1) for row `id`: the first 32 bits of an MD5, so any engine can recompute it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(use)), F.col("id").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 4294967296.0


def between(u: Column, least: int, most: int) -> Column:
    return (F.floor(u * (most - least + 1)) + least).cast("int")


def generate(spark: SparkSession, rows: int, preset: str = "balanced", seed: int = 42) -> DataFrame:
    """(id, attr, lo, hi, payload); the same rows for the same arguments, whatever the partitions.

    lo walks through ten years by whole days with the row's position: its own, from the end, or any.
    Zipf attributes are a rank from 1 to 100 to the power -1.5 without its fraction (1 or 0), except that
    a share of open-ended rows gets one of ten hot values, the ith with weight 1 / i.
    """
    p = PRESETS[preset]
    u = lambda use: unit(seed, use)
    position = {"chronological": F.col("id") - 1, "reverse": rows - F.col("id"), "mixed": F.floor(u(1) * rows)}[p.order]
    current = u(2) < p.open_ratio
    hours = None
    for share, least, most in reversed(WIDTHS[p.width]):
        drawn = between(u(4), least, most)
        hours = drawn if hours is None else F.when(u(3) < share, drawn).otherwise(hours)
    if p.attrs == "uniform":
        attr = between(u(5), 1, 100)
    else:
        weights = [sum(1 / i for i in range(1, n + 1)) for n in range(1, HOT_ATTRS + 1)]
        hot = F.lit(HOT_ATTRS)
        for i in range(HOT_ATTRS - 1, 0, -1):
            hot = F.when(u(7) * weights[-1] < weights[i - 1], i).otherwise(hot)
        attr = F.when(current & (u(6) < p.hot_current), hot).otherwise(F.floor(F.pow(between(u(5), 1, 100).cast("double"), F.lit(-1.5))).cast("int"))
    start = F.lit(START).cast("timestamp_ntz")
    lo = start + F.make_dt_interval(F.pmod(position, F.lit(DAYS)).cast("int"))
    df = spark.range(1, rows + 1).select("id", attr.alias("attr"), lo.alias("lo"), current.alias("current"), hours.alias("hours"), F.concat(F.lit("payload_"), (F.col("id") - 1).cast("string")).alias("payload"))
    return df.select("id", "attr", "lo", F.when(~F.col("current"), F.col("lo") + F.make_dt_interval(F.lit(0), F.col("hours"))).alias("hi"), "payload")
