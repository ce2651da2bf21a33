"""What the two vector searches share: valid vectors, cells of a global tree, and two rounds of visits.

Vectors are projected to a few dimensions by a fixed Gaussian matrix. A kd-tree
over the projections of a bounded sample cuts the space into at most MAX_CELLS
cells; every vector goes to its cell, and a cell is dealt over shards of about
`shard_rows` rows. That table is written once, sorted by nothing else.

First each query searches one shard of its own cell, which gives it a kth score.
Then it visits the shards of those cells only which, by the search's own bound
on the cell's box, may still hold a better one, and takes that score along: a
shard returns only what reaches it. A shard is read once for up to GROUP_QUERIES
of its queries, which stream past it, so candidates are not copied per block of
queries; what grows with both is the visits, for vectors without structure that
no bound can rule out. At most k rows a query and visit come back, and a window
over a query keeps the best k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize

PROJECTED = 8
#: Cells of the tree, and the rows and bytes of the sample that it is built from.
MAX_CELLS, SAMPLE_ROWS, SAMPLE_BYTES = 4096, 65_536, 32_000_000
GROUP_QUERIES, BLOCK_QUERIES = 65_536, 256


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector without null, NaN or infinite components."""
    v = col(vec_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & sound)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
        return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return np.lexsort((ids, -scores))[:k]


@dataclass
class Cells:
    """A kd-tree's splits, node i having the children 2i + 1 and 2i + 2; its leaves are the cells."""

    matrix: np.ndarray
    dim: np.ndarray
    at: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, wanted: int, seed: int = 7) -> Cells:
        matrix = np.random.default_rng(seed).standard_normal((sample.shape[1], PROJECTED))
        depth = max(0, int(np.ceil(np.log2(max(wanted, 1)))))
        dim, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        todo = [(0, sample @ matrix)] if depth else []
        while todo:
            node, P = todo.pop()
            if not len(P):
                continue
            dim[node] = np.argmax(P.max(0) - P.min(0))
            x = P[:, dim[node]]
            at[node] = np.median(x)
            if 2 * node + 1 < len(dim):
                todo += [(2 * node + 1, P[x <= at[node]]), (2 * node + 2, P[x > at[node]])]
        return Cells(matrix, dim, at)

    def of(self, X: np.ndarray) -> np.ndarray:
        node = np.zeros(len(X), np.int64)
        if len(self.dim):
            P, rows = X @ self.matrix, np.arange(len(X))
            for _ in range(int(np.log2(len(self.dim) + 1))):
                node = 2 * node + 1 + (P[rows, self.dim[node]] > self.at[node])
        return node - len(self.dim)


def stacked(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Search:
    """One way to search: what a task knows of a shard, of a cell, and of a query."""

    score_type = "double"

    def prepare(self, ids: np.ndarray, X: np.ndarray) -> object:
        """An index of a shard."""
        raise NotImplementedError

    def run(self, index: object, query_ids: np.ndarray, Q: np.ndarray, bounds: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions of queries, ids, scores) of what may be among each query's k best; where known, at least its bound."""
        raise NotImplementedError

    def coordinates(self, X: np.ndarray) -> np.ndarray:
        """What cells' boxes bound."""
        raise NotImplementedError

    def reach(self, low: np.ndarray, high: np.ndarray, Q: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> np.ndarray:
        """queries x cells: whether a cell with this box may hold a row that a query still wants."""
        raise NotImplementedError


def _boxes(cells: DataFrame, search: Search, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells that have rows, and the corners of their boxes; at most MAX_CELLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for b in batches:
            cell, C = b.column(0).to_numpy(), search.coordinates(stacked(b.column(1), dims))
            for c in np.unique(cell).tolist():
                part = C[cell == c]
                low[c] = np.minimum(low.get(c, np.inf), part.min(0))
                high[c] = np.maximum(high.get(c, -np.inf), part.max(0))
        for c in low:
            n = len(low[c])
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int64()), pa.array(np.arange(n)), pa.array(low[c]), pa.array(high[c])], names=["cell", "d", "low", "high"])

    found = cells.select("cell", "v").mapInArrow(run, "cell long, d long, low double, high double").groupBy("cell", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    t = found.orderBy("cell", "d").toArrow()
    cell = np.unique(t.column("cell").to_numpy())
    return cell, t.column("low").to_numpy().reshape(len(cell), -1), t.column("high").to_numpy().reshape(len(cell), -1)


def _stream(search: Search, dims: int, k: int):
    """Searches of queries (kind 1) that follow the rows of their shard (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, index = None, [], None
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if shard is None or (key[start] != shard).any():
                    shard, rows, index = key[start].copy(), [], None
                part = b.slice(start, end - start)
                kind = part.column(3).to_numpy()
                first = int(np.searchsorted(kind, 1))
                if first:
                    rows.append((part.column(4).to_numpy()[:first].copy(), stacked(part.column(6).slice(0, first), dims).copy()))
                if first == len(kind) or not rows:
                    continue
                if index is None:
                    index = search.prepare(np.concatenate([x for x, _ in rows]), np.concatenate([x for _, x in rows]))
                for at in range(first, len(kind), BLOCK_QUERIES):
                    q = part.slice(at, BLOCK_QUERIES)
                    bound = q.column(7)
                    known = bound.is_valid().to_numpy(zero_copy_only=False)
                    of, ids, score = search.run(index, q.column(4).to_numpy(), stacked(q.column(6), dims), bound.fill_null(0).to_numpy(), known, k)
                    yield pa.RecordBatch.from_arrays([q.column(5).take(pa.array(of)), q.column(4).take(pa.array(of)), pa.array(ids), pa.array(score)], names=["qn", "query_id", "vec_id", "score"])

    return run


def _searched(cells: DataFrame, visits: DataFrame, search: Search, dims: int, k: int) -> DataFrame:
    """(qn, query_id, vec_id, score) of visits (cell, part, qn, query_id, v, bound)."""
    kind = search.score_type
    groups = visits.groupBy("cell", "part").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("groups"))
    rows = cells.join(groups, ["cell", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = rows.select("cell", "part", "group", F.lit(0).alias("kind"), "vec_id", F.lit(None).cast("long").alias("qn"), "v", F.lit(None).cast(kind).alias("bound"))
    asked = visits.join(groups, ["cell", "part"]).withColumn("group", F.pmod(F.xxhash64("qn"), F.col("groups")).cast("int"))
    both = rows.unionByName(asked.select("cell", "part", "group", F.lit(1).alias("kind"), F.col("query_id").alias("vec_id"), "qn", "v", "bound"))
    both = both.select("cell", F.col("part").cast("long").alias("part"), F.col("group").cast("long").alias("group"), "kind", "vec_id", "qn", "v", "bound")
    dealt = both.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell", "part", "group").sortWithinPartitions("cell", "part", "group", "kind")
    return dealt.mapInArrow(_stream(search, dims, k), f"qn long, query_id long, vec_id long, score {kind}")


def _top_of_one_length(data: DataFrame, dims: int, n: int, is_query: Column, k: int, make: Callable[[np.ndarray], Search], shard_rows: int) -> DataFrame:
    spark = data.sparkSession
    share = min(1.0, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)) / n)
    sample = data.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < share * (1 << 30)).select("v").toArrow()
    sample = stacked(sample.column("v").combine_chunks(), dims) if sample.num_rows else np.zeros((1, dims))
    tree = Cells.fit(sample, min(MAX_CELLS, -(-n // shard_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.of(stacked(b.column(1), dims))), b.column(0), b.column(1), b.column(2)], names=["cell", "vec_id", "v", "asks"])

    placed = data.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks")).mapInArrow(place, "cell long, vec_id long, v array<double>, asks boolean")
    placed = materialize(placed, "vector-cells")
    parts = materialize(placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")), "vector-parts")
    cells = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    queries = cells.filter("asks").select("cell", "part", F.col("vec_id").alias("query_id"), "v").distinct()
    queries = materialize(queries.withColumn("qn", F.monotonically_increasing_id()), "vector-queries")
    search = make(sample)
    own = materialize(_searched(cells, queries.withColumn("bound", F.lit(None).cast(search.score_type)), search, dims, k), "vector-own")
    bounds = own.groupBy("qn").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    cell, low, high = _boxes(placed, search, dims)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_QUERIES):
                q = b.slice(at, BLOCK_QUERIES)
                bound = q.column(5)
                known = bound.is_valid().to_numpy(zero_copy_only=False)
                of, to = np.nonzero(search.reach(low, high, stacked(q.column(4), dims), bound.fill_null(0).to_numpy(), known))
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(cell[to]), *[q.column(i).take(of) for i in range(6)]], names=["cell", "own_cell", "own_part", "qn", "query_id", "v", "bound"])

    asking = queries.join(bounds, "qn", "left").select(F.col("cell").alias("own_cell"), F.col("part").alias("own_part"), "qn", "query_id", "v", "bound")
    visits = asking.mapInArrow(route, f"cell long, own_cell long, own_part int, qn long, query_id long, v array<double>, bound {search.score_type}")
    visits = visits.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = materialize(visits.filter("cell <> own_cell OR part <> own_part").select("cell", "part", "qn", "query_id", "v", "bound"), "vector-visits")
    return own.unionByName(_searched(cells, visits, search, dims, k))


def top_of_all(data: DataFrame, is_query: Column, k: int, make: Callable[[np.ndarray], Search], shard_rows: int) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of every query; vectors of different lengths never meet.

    data has vec_id and v; make(sample) gives the Search.
    """
    lengths = data.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()
    found = None
    for r in sorted(lengths, key=lambda r: r["dims"]):
        part = _top_of_one_length(data.filter(F.size("v") == r["dims"]), r["dims"], r["n"], is_query, k, make, shard_rows).withColumn("dims", F.lit(r["dims"]))
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = make(np.zeros((1, 1))).score_type
        return data.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast(kind).alias("score"))
    w = Window.partitionBy("dims", "qn").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
