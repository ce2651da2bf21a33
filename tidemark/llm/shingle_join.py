"""Exact similarity join of texts on their distinct word shingles.

Two texts are similar when the Jaccard similarity of their shingles reaches a
bound. All texts order their shingles alike: by hash, but common shingles last
(common_shingles below). A text's prefix is so many of its first shingles that
any similar text has one of them in its own prefix; the texts of one prefix
shingle are a list. Lists of equal texts count once, and those whose texts are
all grouped already not at all.

Within a list, the lengths of two texts and how their sketches differ rule out
almost all pairs that aren't similar, and no other. What is left connects texts
to families, mostly of a few texts; a family's texts are then compared on their
whole shingle sets. No pairs leave a list or a family: each emits stars.

A list or family of very many texts or shingles is dealt into blocks, and every
two blocks of it meet, so what a task holds stays bounded; its work grows with
the square of a family whose texts are nearly, but not, similar. Shingles are
64-bit hashes; results are exact up to their collisions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, in_blocks, materialize, portions
from .components import components
from .windows import Words, distinct, gram_hashes

#: Shingles found in that many prefixes or more count as common; so many of them, the most frequent, go last.
COMMON_FROM, COMMON = 16, 1 << 20
#: Texts and shingles of a block of a list or family.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Bits of the filter that spares texts which no candidate names the way to a join.
FILTER_BITS = 26
#: Columns of an incidence or sketch matrix that are multiplied at once.
STRIP = 4096


def word_sets(values: list[bytes], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every text its distinct shingles and its distinct words, as sorted 64-bit hashes."""
    for _, counts, (words,) in Words.units([v.lower() for v in values], 1):
        grams = gram_hashes(words, shingle)
        at = 0
        for n in counts.tolist():
            own = words[at : at + n]
            yield distinct(grams[at : at + n - shingle + 1] if n >= shingle else gram_hashes(own, n) if n else own), distinct(own)
            at += n


def prefix_length(n: int, similarity: float) -> int:
    """So many of n shingles, first in order, that any similar text has one of them among its own."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def lists_of(arrays: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit integers as one list column."""
    ends = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Keys and texts of (k, t) batches; copies of a text count once in a task."""
    seen: set[bytes] = set()
    for b in portions(batches):
        keys, rows = b.column(0).to_pylist(), []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                rows.append(i)
        if rows:
            yield [keys[i] for i in rows], binary_values(b.column(1).take(pa.array(rows)))


def sketch(x: np.ndarray) -> bytes:
    """A bit for each residue of the hashes x, set if an odd number of them has it; a power of two of bits, from len(x) on."""
    size = 64 << max(0, math.ceil(math.log2(max(len(x), 1) / 64)))
    return np.packbits(np.bincount((x % np.uint64(size)).astype(np.int64), minlength=size) & 1).tobytes()


def _prefixes(shingle: int, similarity: float, common: np.ndarray | None):
    """(k, n, h, s): the number of a text's shingles, its prefix (zero without any), its sketch once `common` is known."""

    def prefix(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(1, np.uint64)
        if common is not None and len(common):
            last = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x
            x = np.concatenate([x[~last], x[last]])
        return x[: prefix_length(len(x), similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in unseen(batches):
            sets = [x for x, _ in word_sets(texts, shingle)]
            sketches = [None if common is None else sketch(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), lists_of([prefix(x) for x in sets]), pa.array(sketches, pa.binary())], names=["k", "n", "h", "s"]
            )

    return run


PREFIX = "k binary, n int, h array<long>, s binary"


def common_shingles(texts: DataFrame, shingle: int, similarity: float) -> np.ndarray:
    """The most frequent shingles of the texts' prefixes by hash, sorted; COMMON bounds them.

    Any fixed set would do: it only decides which shingles go last.
    """
    h = texts.mapInArrow(_prefixes(shingle, similarity, None), PREFIX).select(F.explode("h").alias("h"))
    often = h.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "h").limit(COMMON)
    return np.sort(often.select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64))


def differing(one: list[bytes], other: list[bytes]) -> np.ndarray:
    """The differing bits of sketches of one size and others of that size or larger ones, which are folded to it."""
    size = len(one[0]) * 8

    def bits(sketches: list[bytes]) -> np.ndarray:
        x = np.zeros((len(sketches), size // 8), np.uint8)
        for i, s in enumerate(sketches):
            x[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size // 8), axis=0)
        return x

    x, y = bits(one), bits(other)
    same = np.zeros((len(one), len(other)), np.float32)
    for at in range(0, size // 8, STRIP // 8):
        left, right = (np.unpackbits(z[:, at : at + STRIP // 8], axis=1).astype(np.float32) * 2 - 1 for z in (x, y))
        same += left @ right.T
    return (size - same) / 2


def candidates(n: np.ndarray, g: np.ndarray, sketches: list[bytes], similarity: float) -> np.ndarray:
    """Whether texts of n shingles, in groups g, can be similar: a symmetric matrix.

    Sketches differ in at most as many bits as the two texts have shingles that the other lacks.
    """
    ok = (g[:, None] != g[None, :]) & (np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :]) - 1e-6)
    most = (1 - similarity) / (1 + similarity)
    size = np.array([len(s) for s in sketches])
    for least in np.unique(size[ok.any(axis=1)]):
        a, b = np.flatnonzero(size == least), np.flatnonzero((size == least) | ok[size == least].any(axis=0) & (size > least))
        keep = differing([sketches[i] for i in a], [sketches[i] for i in b]) <= most * (n[a][:, None] + n[b][None, :]) + 1e-6
        ok[np.ix_(a, b)] &= keep
        ok[np.ix_(b, a)] &= keep.T
    return ok


def first_linked(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the first that it is connected to."""
    n = len(link)
    group = np.arange(n)
    while True:
        least = np.concatenate([np.where(link[i : i + 256], group[None, :], n).min(axis=1) for i in range(0, n, 256)])
        least = np.minimum(group, least)
        least = np.minimum(least, least[least])
        if (least == group).all():
            return group
        group = least


def _candidate_stars(similarity: float):
    """(a, b): stars of ids that candidate pairs of a list x connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            a, to = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row in b.column(0):
                x = row.values
                ids, first = np.unique(x.field("id").to_numpy(), return_index=True)
                if len(ids) < 2:
                    continue
                n, g = (x.field(c).to_numpy()[first] for c in ("n", "g"))
                group = first_linked(candidates(n, g, x.field("s").take(pa.array(first)).to_pylist(), similarity))
                rest = group != np.arange(len(group))
                a.append(ids[rest])
                to.append(ids[group[rest]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(to))], names=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections, by products of incidence matrices, some columns at a time."""
    n = np.array([len(x) for x in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = np.bincount(at, minlength=len(values)) > 1
    column = (np.cumsum(shared) - 1)[at]
    order = np.argsort(column, kind="stable")
    order = order[shared[at[order]]]
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + STRIP if len(column) else 0, STRIP))
    for low, high in zip(cuts, cuts[1:], strict=False):
        part = np.zeros((len(sets), STRIP), np.float32)
        part[owner[low:high], column[low:high] % STRIP] = 1
        both += part @ part.T
    np.fill_diagonal(both, n)
    return both


def _similar_stars(similarity: float):
    """(a, b): stars of keys that similar pairs of a family x connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            for row in b.column(0):
                keys, first = np.unique(np.array(row.values.field("k").to_pylist(), object), return_index=True)
                if len(keys) < 2:
                    continue
                g = row.values.field("g").to_numpy()[first]
                x = row.values.field("x")
                sets = [x[i].values.to_numpy().view(np.uint64) for i in first.tolist()]
                n = np.array([len(x) for x in sets])
                if len(sets) == 2:
                    both = np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)), np.float32)
                else:
                    both = overlaps(sets)
                link = (both >= similarity * (n[:, None] + n[None, :] - both) - 1e-6) & (g[:, None] != g[None, :])
                group = first_linked(link)
                rest = np.flatnonzero(group != np.arange(len(group))).tolist()
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in rest], pa.binary()), pa.array([keys[group[i]] for i in rest], pa.binary())], names=["a", "b"])

    return run


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the first FILTER_BITS bits of a key, set where `keys` has one: 8 MB at most."""
    at = F.shiftright(F.conv(F.hex(F.substring("k", 1, 4)), 16, 10).cast("long"), 32 - FILTER_BITS)
    parts = keys.select((at / 32768).cast("long").alias("part"), (at % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts.collect():
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def shingle_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(k, x): the sorted shingles of those texts (k, t) that `wanted` (k, distinct) names.

    Texts pass a filter of bounded size before their shingles are made, so that only those of wanted texts, and few others, are shuffled.
    """
    bits = texts.sparkSession.sparkContext.broadcast(_filter_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in portions(batches):
                at = np.frombuffer(b"".join(k[:4] for k in b.column(0).to_pylist()), ">u4") >> (32 - FILTER_BITS)
                yield b.filter(pa.array((bits.value[at >> 3] >> (at & 7) & 1).astype(bool)))

        for keys, values in unseen(passing(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists_of([x for x, _ in word_sets(values, shingle)])], names=["k", "x"])

    made = texts.mapInArrow(run, "k binary, x array<long>")
    return made.join(wanted, "k", "left_semi").dropDuplicates(["k"])


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-6)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return run


def verified(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the written pairs (a, b) of texts (k, t) that are similar."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "similar-wanted")
    sets = materialize(shingle_sets(texts, wanted, shingle), "similar-sets")
    both = pairs.join(sets.withColumnRenamed("k", "a"), "a").join(sets.withColumnsRenamed({"k": "b", "x": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a binary, b binary")


def join_groups(texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): edges that connect whatever similar texts (k, t) are of different groups (node, root)."""
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, shingle, similarity))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _prefixes(shingle, similarity, common.value)(batches)

    read = texts.mapInArrow(prefixes, PREFIX).join(roots, F.col("k") == roots.node, "left")
    read = materialize(read.select("k", F.xxhash64("k").alias("id"), F.xxhash64(F.coalesce("root", "k")).alias("g"), "n", "h", "s"), "similar-prefixes")
    posted = read.select("id", "g", F.explode("h").alias("h"))
    # Lists of equal texts have equal counts, groups and sums; a sum that overflows tells a list from all others.
    total = F.coalesce(F.try_sum(F.shiftrightunsigned("id", 24)), F.col("h"))
    lists = posted.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("texts"), total.alias("sum")).filter("lo <> hi")
    lists = lists.groupBy("texts", "lo", "hi", "sum").agg(F.min("h").alias("h"))
    lists = materialize(lists.select("h", F.ceil(F.col("texts") / BLOCK_TEXTS).alias("blocks")), "similar-lists")
    dealt = in_blocks(posted.join(lists, "h"), F.col("blocks"), F.col("id")).select("h", "u", "v", "id", "g").join(read.select("id", "n", "s"), "id")
    stars = dealt.groupBy("h", "u", "v").agg(F.collect_list(F.struct("id", "g", "n", "s")).alias("x")).select("x").mapInArrow(_candidate_stars(similarity), "a long, b long")
    linked = components(stars, "similar-families")
    family = linked.select(F.col("node").alias("id"), F.col("root").alias("f")).unionByName(linked.select(F.col("root").alias("id"), F.col("root").alias("f")).distinct())
    members = materialize(read.select("id", "k", "g", "n").join(family, "id").dropDuplicates(["k"]), "similar-members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    blocks = materialize(members.groupBy("f").agg(blocks.alias("blocks")), "similar-blocks")
    sets = materialize(shingle_sets(texts, members.select("k"), shingle), "similar-sets")
    whole = in_blocks(members.join(blocks, "f"), F.greatest("blocks", F.lit(1)), F.col("id")).select("f", "u", "v", "k", "g").join(sets, "k")
    return whole.groupBy("f", "u", "v").agg(F.collect_list(F.struct("k", "g", "x")).alias("x")).select("x").mapInArrow(_similar_stars(similarity), "a binary, b binary")
