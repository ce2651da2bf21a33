"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest permitted length are cut into pieces of that
length and a rest. Pieces are dealt round robin over shards of bounded size,
written first so that the deal stands; each shard is packed longest piece first,
of equals by document and piece. A
piece goes to the open bin whose remaining room is the smallest that holds it,
of equals the one filled last.
If none does, a bin is opened: for every permitted length that holds the
piece, the pieces still to come are tried greedily, longest first, and the
length of least cost per token that it would then hold is opened (ties: the
shorter). Costs are given per length, so all lengths are weighed jointly. At
the end each bin is cut down to the shortest permitted length that holds its
contents.

One row per piece: doc_id (of the id column's own type), piece, start (token offset in the document), n_tokens, bin_id,
bin_start (offset in the bin), bin_tokens (the bin's contents), bin_size. A
null or empty text has no tokens: one piece of length 0, in no bin (bin_id
null). Repeated rows and null ids are pieces like any others. An empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, row_count_per, schema_of, text_or_empty

#: Permitted sequence lengths of the query and the pipeline.
SIZES = (256, 512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, in tokens: what each one takes for its own handling.
OVERHEAD = 32


def default_costs(sizes: tuple[int, ...]) -> tuple[float, ...]:
    return tuple(float(s + OVERHEAD) for s in sizes)


def pack(lengths: np.ndarray, sizes: tuple[int, ...], costs: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Bin and offset of every length (all at least 1), then contents and size of every bin."""
    top = sizes[-1]
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=top + 1)
    present = sorted(np.flatnonzero(left).tolist())
    left = left.tolist()
    room: list[list[int]] = [[] for _ in range(top + 1)]
    mask = 0
    bins, starts = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    opened: list[int] = []
    plans: dict[tuple[int, int], int] = {}

    def greedy(size: int, first: int) -> int:
        """Tokens that a new bin of this size would come to hold."""
        full, last = first, bisect_left(present, first + 1) - 1
        while last >= 0 and full < size:
            last = min(last, bisect_left(present, size - full + 1) - 1)
            if last < 0:
                break
            n = min(left[present[last]], (size - full) // present[last])
            full += n * present[last]
            last -= 1
        return full

    for at in order.tolist():
        n = int(lengths[at])
        left[n] -= 1
        while present and left[present[-1]] == 0:
            present.pop()
        fits = mask >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                mask &= ~(1 << space)
            space -= n
        else:
            b = len(used)
            size = min(((c / greedy(s, n), s) for s, c in zip(sizes, costs, strict=True) if s >= n))[1]
            used.append(0)
            opened.append(size)
            space = size - n
        bins[at], starts[at] = b, used[b]
        used[b] += n
        if space:
            room[space].append(b)
            mask |= 1 << space
    return bins, starts, used, [sizes[bisect_left(sizes, u)] for u in used]


def _pack_shard(sizes: tuple[int, ...], costs: tuple[float, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        t = pa.Table.from_batches(found)
        shards = t.column("shard").to_numpy()
        for shard in np.unique(shards):
            part = t.filter(pa.array(shards == shard)).sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            bins, starts, used, size = pack(part.column("n_tokens").to_numpy(), sizes, costs)
            made = {"bin_id": bins + (int(shard) << 32), "bin_start": starts, "bin_tokens": np.array(used, np.int64)[bins], "bin_size": np.array(size, np.int64)[bins]}
            for name, x in made.items():
                part = part.append_column(name, pa.array(x))
            yield from part.drop_columns(["shard"]).combine_chunks().to_batches(max_chunksize=50_000)

    return run


def best_fit_packing(
    docs: DataFrame, n_tokens: Column, id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES, costs: tuple[float, ...] | None = None, shard_rows: int = 50_000
) -> DataFrame:
    sizes = tuple(sorted(sizes))
    costs = costs or default_costs(sizes)
    top = sizes[-1]
    n = F.coalesce(n_tokens.cast("long"), F.lit(0))
    counted = docs.select(col(id_col).alias("doc_id"), n.alias("n"))
    pieces = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top).cast("int") - 1, F.lit(0)))).alias("piece"))
    start = F.col("piece").cast("long") * top
    pieces = materialize(pieces.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(top).cast("long")).alias("n_tokens")), "pieces")
    empty, full = pieces.filter("n_tokens = 0"), pieces.filter("n_tokens > 0")
    n_shards = row_count_per(full, shard_rows)
    dealt = full.repartition(n_shards).withColumn("shard", F.spark_partition_id().cast("long"))
    more = ("bin_id", "bin_start", "bin_tokens", "bin_size")
    packed = dealt.mapInArrow(_pack_shard(sizes, costs), schema_of(pieces, ["doc_id"], "piece int, start long, n_tokens long, " + ", ".join(f"{m} long" for m in more)))
    return packed.unionByName(empty.select("*", *[F.lit(None).cast("long").alias(m) for m in more]))


def word_count(text_col: str = "text") -> Column:
    """Words of a text, between ASCII white space."""
    t = F.btrim(text_or_empty(text_col), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+", -1)))
