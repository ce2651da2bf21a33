"""What a plan does: operators, pushed filters, columns read; and counters of planned queries."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def operators(df: DataFrame) -> Counter:
    """Physical operators by name."""
    heads = re.findall(r"^\((\d+)\) (\w+(?: \w+)?)", plan_text(df), re.M)
    return Counter(name.strip() for _, name in dict(heads).items())


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", plan_text(df))


def read_columns(df: DataFrame) -> list[list[str]]:
    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<(.*?)>", plan_text(df))]


class Counters:
    """Counts of queries looked at: how many scanned, pruned and shuffled."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.stats: Counter = Counter(planned=0, scans=0, pruned=0, shuffles=0, joins=0)

    def see(self, df: DataFrame) -> DataFrame:
        found = operators(df)
        self.stats["planned"] += 1
        self.stats["scans"] += sum(n for k, n in found.items() if k.startswith("Scan"))
        self.stats["pruned"] += sum(bool(f) for f in pushed_filters(df))
        self.stats["shuffles"] += found["Exchange"]
        self.stats["joins"] += sum(n for k, n in found.items() if "Join" in k)
        return df
