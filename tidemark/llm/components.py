"""Connected components of a distributed edge list, by alternating large and small stars.

Every round is a few joins and map-side combined aggregations over the edges;
nothing is gathered in one place. Each round's edges are written to the shared
folder, which cuts the lineage, and the minima are written before they are
joined back so that a node with very many neighbours can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """(u, v, m): m is the least neighbour of u."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    return edges.join(least, "u")


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the least of its component."""
    e = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before: tuple = ()
    while (now := _sum(e)) != before:
        before = now
        if not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, name).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, name)
        small = _with_least(large, name)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct(), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
