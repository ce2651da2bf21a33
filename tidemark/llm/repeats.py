"""What the two removers of repeated windows share: from runs of windows to removed spans.

 1. runs whose anchor occurs at least twice are kept (`repeated` anchors);
 2. if all runs of an anchor have equal content, each of their windows repeats;
 3. else runs of equal (anchor, content) are counted: of two or more, each
    window repeats; a single one is settled against one representative of each
    content of its anchor, by whichever finer method the operator has.

Copies of a text are runs like any others, so a text that occurs twice repeats
itself. Verdicts are spans of units of a text's key. Everything is grouped by
hashes with map-side combining; sides that are aggregated are written before
they are joined, so that Spark can split a hot key's other side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, materialize, portions, text_key, text_or_empty
from .windows import SLICE, runs, window_hashes

RUN = "k binary, a long, c long, lo int, hi int, at int"
SPAN = "k binary, s int, e int"


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(text_key(text_col).alias("k"), text_or_empty(text_col).alias("t"))


def _run_rows(kind, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            keys = b.column(0)
            for owner, a, c, lo, hi, at in runs(kind, binary_values(b.column(1)), width):
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(owner)), pa.array(a), pa.array(c), *(pa.array(x.astype(np.int32)) for x in (lo, hi, at))], names=["k", "a", "c", "lo", "hi", "at"]
                )

    return run


def run_rows(texts: DataFrame, kind, width: int) -> DataFrame:
    """The runs of (k, t) rows."""
    return texts.mapInArrow(_run_rows(kind, width), RUN)


def anchor_entries(rows: DataFrame) -> DataFrame:
    """(a, n, c_min, c_max): occurrences of each anchor, and whether their contents differ."""
    return rows.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c_min"), F.max("c").alias("c_max"))


class Settled:
    """Steps 2 and 3 above for the runs of repeated anchors (a, uniform)."""

    def __init__(self, rows: DataFrame, repeated: DataFrame, width: int, name: str):
        # Grouped without the join's key, which the place in the text implies: Spark may then split a hot anchor.
        same = [F.first(c).alias(c) for c in ("a", "c", "uniform")]
        kept = rows.join(repeated, "a").groupBy("k", "lo", "hi", "at").agg(F.count("*").alias("m"), *same)
        kept = materialize(kept, f"{name}-runs")
        mixed = kept.filter(~F.col("uniform")).groupBy("a", "c").agg(F.sum("m").alias("m"), F.min(F.struct("k", "lo", "hi", "at")).alias("r"))
        mixed = materialize(mixed, f"{name}-mixed")
        whole = kept.filter("uniform").select("k", "lo", "hi")
        whole = whole.unionByName(kept.filter(~F.col("uniform")).join(mixed.filter("m > 1").select("a", "c"), ["a", "c"]).select("k", "lo", "hi"))
        #: Spans settled as a whole.
        self.spans = whole.select("k", F.col("lo").alias("s"), (F.col("hi") + width).alias("e"))
        groups = materialize(mixed.groupBy("a").agg(F.min("m").alias("least"), F.count("*").alias("contents")).filter("least = 1").select("a", "contents"), f"{name}-groups")
        #: Representatives still to settle: (a, contents, m, k, lo, hi, at).
        self.open = materialize(mixed.join(groups, "a").select("a", "contents", "m", "r.*"), f"{name}-open")


def with_text(texts: DataFrame, rows: DataFrame, fn: Callable[[bytes, bytes, list[dict]], Iterator[pa.RecordBatch]], fields: str, schema: str) -> DataFrame:
    """fn(k, text, rows of k) for every text key in rows; copies of a text count once in a task."""
    per_key = materialize(rows.groupBy("k").agg(F.collect_list(F.struct(*fields.split())).alias("x")), "repeat-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in portions(batches):
            for k, text, x in zip(b.column("k").to_pylist(), binary_values(b.column("t")), b.column("x"), strict=True):
                if k not in seen:
                    seen.add(k)
                    yield from fn(k, text, x.as_py())

    return texts.join(per_key, "k").select("k", "t", "x").mapInArrow(run, schema)


def window_spans(texts: DataFrame, rows: DataFrame, kind, width: int, name: str) -> DataFrame:
    """Spans of the windows of rows (k, lo, hi, m) that occur twice among them, by two hashes of each window."""

    def explode(k: bytes, text: bytes, x: list[dict]) -> Iterator[pa.RecordBatch]:
        _, _, unit = next(iter(kind.units([text])))
        if len(unit[0]) <= 4 * SLICE:
            ranges = [(0, len(unit[0]), np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in x])))]
        else:
            ranges = [(r["lo"], r["hi"] + width, np.arange(r["lo"], r["hi"] + 1)) for r in x]
        for lo, end, start in ranges:
            one, two = window_hashes(kind, tuple(u[lo:end] for u in unit), width)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(start), pa.binary()), pa.array(start.astype(np.int32)), pa.array(one[start - lo]), pa.array(two[start - lo])], names=["k", "s", "w1", "w2"]
            )

    windows = materialize(with_text(texts, rows, explode, "lo hi", "k binary, s int, w1 long, w2 long"), f"{name}-windows")
    at = F.struct("k", "s")
    twice = windows.groupBy("w1", "w2").agg(F.min(at).alias("x"), F.max(at).alias("y")).filter("x <> y").select("w1", "w2")
    hits = windows.join(materialize(twice, f"{name}-twice"), ["w1", "w2"])
    return hits.select("k", "s", (F.col("s") + width).alias("e"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal covered spans, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = out[-1][0], e
        else:
            out.append((s, e))
    return out


def spans_by_text(spans: DataFrame, name: str) -> DataFrame:
    """(k, x): the spans of every text that has any; bounded by the text's own length."""
    return materialize(spans.groupBy("k").agg(F.collect_set(F.struct("s", "e")).alias("x")), f"{name}-spans")
