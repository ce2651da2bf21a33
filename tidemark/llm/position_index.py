"""A byte-position inverted index over 64-bit fingerprints, with count filtering.

Fingerprints link when at most `max_distance` bits differ, so that at least
8 - max_distance of their 8 bytes are equal at the same position. Each distinct
fingerprint is posted under the bytes of sets of positions chosen such that any
guaranteed number of equal positions contains one of the sets. Within a posting
list the equal positional bytes of each pair are tallied, pairs under the
guaranteed number are dropped, and the others are verified by their differing
bits. A list emits a star per linked group, never its pairs.

A list of more than `list_rows` fingerprints is posted again under each further
position, which the pairs looked for must also share; what is still longer is
dealt into blocks, and every two blocks of a list meet. Either way all lists are
tallied and verified alike, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, materialize, portions

LIST_ROWS = 1024
#: Rows of a list compared with all its others at once.
STRIP = 256


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of positions among 8 such that any 4 positions contain one of them.

    All sets of 4, or Turan's system of 20 triples: with the positions in three
    parts, the triples within a part and those of two from a part and one from the next.
    """
    if size == 4:
        return list(combinations(range(8), 4))
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inner = [t for p in parts for t in combinations(p, 3)]
    return inner + [(*two, one) for i, p in enumerate(parts) for two in combinations(p, 2) for one in parts[(i + 1) % 3]]


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def _posting_keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    keys = []
    for i, s in enumerate(sets):
        key = F.lit(i).cast("long")
        for p in s:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
        keys.append(key)
    return F.explode(F.array(*keys))


def _longer_keys(key: Column, fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """The key of a list with one more position of the fingerprint, for every position that the list's set leaves."""
    which = F.shiftright(key, 8 * len(sets[0]))
    more = [F.shiftleft(F.shiftleft(key, 3).bitwiseOR(F.lit(p)), 8).bitwiseOR(_byte(fp, p)) for p in range(8)]
    free = [F.array(*[x for p, x in enumerate(more) if p not in s]) for s in sets]
    chosen = free[0]
    for i, x in enumerate(free[1:], 1):
        chosen = F.when(which == i, x).otherwise(chosen)
    return F.explode(chosen)


def list_edges(x: np.ndarray, max_distance: int, and_nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges between positions of the fingerprints x: each to the first of its linked group.

    and_nearest: also each to its nearest other, where that is within max_distance.
    """
    n = len(x)
    link = np.empty((n, n), bool)
    best = np.empty(n, np.int64)
    near = np.empty(n, bool)
    for i in range(0, n, STRIP):
        differ = x[i : i + STRIP, None] ^ x[None, :]
        tally = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        bits = np.bitwise_count(differ)
        link[i : i + STRIP] = (tally >= 8 - max_distance) & (bits <= max_distance)
        if and_nearest:
            own = np.arange(len(differ))
            bits[own, own + i] = 255
            best[i : i + STRIP] = bits.argmin(axis=1)
            near[i : i + STRIP] = bits[own, best[i : i + STRIP]] <= max_distance
    group = np.arange(n)
    while True:
        least = np.concatenate([np.where(link[i : i + STRIP], group[None, :], n).min(axis=1) for i in range(0, n, STRIP)])
        least = np.minimum(least, least[least])
        if (least == group).all():
            break
        group = least
    rest = np.flatnonzero(group != np.arange(n))
    if not and_nearest:
        return rest, group[rest]
    near = np.flatnonzero(near)
    return np.concatenate([rest, near]), np.concatenate([group[rest], best[near]])


def _edges_of_lists(max_distance: int, and_nearest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            column = b.column(0)
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            flat = column.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(ends)
            pair = ends[:-1][size == 2]
            near = np.bitwise_count((flat[pair] ^ flat[pair + 1]).view(np.uint64)) <= max_distance
            a, to = [flat[pair][near]], [flat[pair + 1][near]]
            for start, end in zip(ends[:-1][size > 2].tolist(), ends[1:][size > 2].tolist(), strict=True):
                x = np.unique(flat[start:end])
                one, other = list_edges(x.view(np.uint64), max_distance, and_nearest)
                a.append(x[one])
                to.append(x[other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(to))], names=["a", "b"])

    return run


def links(fps: DataFrame, max_distance: int = 4, key_bytes: int = 3, and_nearest: bool = False, list_rows: int | None = None) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints `fp` whose components are those of all links.

    key_bytes: 3, or 4 for shorter lists but 70 postings of a fingerprint instead of 20.
    and_nearest: also an edge from each fingerprint of a list to its nearest there.
    """
    if max_distance not in (0, 2, 4):
        raise ValueError("max_distance is 0, 2 or 4")
    list_rows = list_rows or LIST_ROWS
    sets = position_sets(key_bytes)
    posted = fps.select(_posting_keys(F.col("fp"), sets).alias("key"), "fp")
    sizes = materialize(posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "position-lists")
    members = posted.join(sizes, "key")
    run = _edges_of_lists(max_distance, and_nearest)
    edges = members.filter(F.col("n") <= list_rows).groupBy("key").agg(F.collect_list("fp").alias("x")).select("x").mapInArrow(run, "a long, b long")
    if sizes.filter(F.col("n") > list_rows).isEmpty():
        return edges
    long = members.filter(F.col("n") > list_rows).select("key", "fp")
    if key_bytes < 8 - max_distance:
        long = long.select(_longer_keys(F.col("key"), F.col("fp"), sets).alias("key"), "fp")
    sizes = materialize(long.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "position-lists")
    dealt = in_blocks(long.join(sizes, "key"), F.ceil(F.col("n") / list_rows), F.col("fp"))
    return edges.unionByName(dealt.groupBy("key", "u", "v").agg(F.collect_list("fp").alias("x")).select("x").mapInArrow(run, "a long, b long"))
