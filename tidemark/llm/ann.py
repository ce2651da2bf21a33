"""Approximate nearest neighbours by stable projections and incremental search.

Largest inner product becomes nearest Euclidean neighbour by one more
coordinate, sqrt(M^2 - |x|^2), that is 0 for queries. Augmented vectors are
projected to a few dimensions by a fixed Gaussian (2-stable) matrix, so that a
squared projected distance over the squared true distance is chi-square with
that many degrees of freedom. A shard's projections are indexed by a kd-tree,
which a query walks from the root, leaving out branches that its test rules
out; leaves are met in order of their projected distance, and of a leaf those
points are verified on their original vectors whose own projection passes the
test. The test: a point nearer than the query's kth would, with probability
`confidence` by the chi-square distribution, have a smaller projection. The
search stops when no leaf is left that passes. The same test picks the cells
that a query visits at all (vectors.py).

A block of queries walks together: of the queries that meet a leaf in one turn,
projections and scores are matrix products, with room for their rounding, and
what may be among the k best is then measured pair by pair. Of equal vectors of
a shard only those of the smallest ids are looked at, as no other can be among
the k best.

On vectors without structure most points pass, as their distances differ
little; the share verified is the chi-square distribution's at the test.

Null and zero vectors and those holding null or non-finite components take no
part. A row never answers a query with its own vec_id. Repeated rows are rows
of their own as candidates; as queries they count once. Ties go to the smaller
id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import PROJECTED, Search, top_of_all, valid_vectors

EPS = np.finfo(float).eps
#: Components multiplied at a time where scores are measured one by one.
VERIFIED_VALUES = 1 << 22


def chi_square_quantile(p: float, dof: int) -> float:
    """The value below which a chi-square variable of an even dof stays with probability p."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@dataclass
class Tree:
    """A kd-tree: boxes of all nodes, children (-1: none), and the rows of leaves, which lie next to each other."""

    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    start: np.ndarray
    end: np.ndarray
    order: np.ndarray


@dataclass
class Walk(Tree):
    """A tree as a block of queries has walked it: where each query's leaves begin, the leaves, nearest first, and their distances."""

    first: np.ndarray
    leaf: np.ndarray
    away: np.ndarray


def kd_tree(P: np.ndarray, leaf_rows: int) -> Tree:
    """Nodes split at the median of the widest dimension; equal points stay together."""
    low, high, child, start, end, order = [], [], [], [], [], []
    todo = [(np.arange(len(P)), -1, 0)]
    placed = 0
    while todo:
        rows, parent, side = todo.pop()
        node = len(low)
        if parent >= 0:
            child[parent][side] = node
        box = P[rows]
        low.append(box.min(0))
        high.append(box.max(0))
        child.append([-1, -1])
        start.append(placed)
        end.append(placed)
        if len(rows) > leaf_rows:
            dim = int(np.argmax(high[-1] - low[-1]))
            x = box[:, dim]
            left = x <= np.median(x)
            if left.all():
                left = x < x.max()
            if left.any():
                todo += [(rows[~left], node, 1), (rows[left], node, 0)]
                continue
        order.append(np.sort(rows))
        placed += len(rows)
        end[-1] = placed
    return Tree(np.array(low), np.array(high), np.array(child), np.array(start), np.array(end), np.concatenate(order))


def gaps(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances of points and boxes."""
    gap = np.maximum(np.maximum(low - p, p - high), 0)
    return np.einsum("...i,...i->...", gap, gap)


def earlier_copies(ids: np.ndarray, X: np.ndarray) -> np.ndarray:
    """For each row, at least so many rows of smaller ids have its vector, whichever one id is left out."""
    order = np.lexsort((ids, (np.ascontiguousarray(X).view(np.uint64) * np.arange(1, 2 * X.shape[1], 2, dtype=np.uint64)).sum(1)))
    X, sorted_ids = X[order], ids[order]
    vector = np.append(True, (X[1:] != X[:-1]).any(1))
    row = vector | np.append(True, sorted_ids[1:] != sorted_ids[:-1])
    begins, at, of = np.flatnonzero(row), np.cumsum(row) - 1, np.cumsum(vector) - 1
    first = np.flatnonzero(vector)
    most = np.maximum.reduceat(np.diff(begins, append=len(ids)), at[first])
    out = np.empty(len(ids), np.int64)
    out[order] = begins[at] - first[of] - most[of]
    return out


class ProjectedSearch(Search):
    """Nearest by the inner product; peak is the largest squared norm."""

    def __init__(self, dims: int, peak: float, leaf_rows: int = 64, confidence: float = 0.95):
        self.peak, self.leaf_rows = peak, leaf_rows
        self.matrix = np.random.default_rng(7).standard_normal((dims + 1, PROJECTED))
        self.quantile = chi_square_quantile(confidence, PROJECTED)

    def coordinates(self, X: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.peak - np.einsum("ij,ij->i", X, X), 0))
        return X @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def limit(self, Q: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The largest squared projected distance that passes the test of queries whose kth score is known."""
        return np.where(known, self.farthest(np.einsum("ij,ij->i", Q, Q), bounds), np.inf)

    def farthest(self, norms: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The same for known scores; with room for their rounding, which matters where copies of the longest vector are nearest."""
        return self.quantile * (np.maximum(norms + self.peak - 2 * kth, 0) + 4 * len(self.matrix) * EPS * (norms + self.peak))

    def reach(self, low: np.ndarray, high: np.ndarray, Q: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> np.ndarray:
        return gaps(low[None], high[None], (Q @ self.matrix[:-1])[:, None]) <= self.limit(Q, bounds, known)[:, None]

    def prepare(self, ids: np.ndarray, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tree, np.ndarray]:
        P = self.coordinates(X)
        tree = kd_tree(P, self.leaf_rows)
        ids, X = ids[tree.order], X[tree.order]
        return ids, X, P[tree.order], tree, earlier_copies(ids, X)

    def walk(self, tree: Tree, PQ: np.ndarray, limits: np.ndarray) -> Walk:
        """All queries from the root, a level at a time; a query enters no branch that doesn't pass its limit."""
        at, node, found = np.arange(len(PQ)), np.zeros(len(PQ), np.int64), []
        while len(node):
            gap = gaps(tree.low[node], tree.high[node], PQ[at])
            passed = gap <= limits[at]
            at, node, gap = at[passed], node[passed], gap[passed]
            leaf = tree.child[node, 0] < 0
            found.append((at[leaf], node[leaf], gap[leaf]))
            at, node = np.repeat(at[~leaf], 2), tree.child[node[~leaf]].ravel()
        at, node, gap = (np.concatenate(x) for x in zip(*found, strict=True))
        near = np.lexsort((gap, at))
        return Walk(**vars(tree), first=np.searchsorted(at[near], np.arange(len(PQ) + 1)), leaf=node[near], away=gap[near])

    def leaves(self, walk: Walk, i: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Query i's leaves within the limit and their distances, nearest first."""
        begin, end = walk.first[i : i + 2]
        here = slice(begin, begin + np.searchsorted(walk.away[begin:end], limit, side="right"))
        return walk.leaf[here], walk.away[here]

    def run(self, index: tuple, query_ids: np.ndarray, Q: np.ndarray, bounds: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, X, P, tree, earlier = index
        # Of a vector's copies only those of the smallest ids can be among the k best.
        open_ = earlier < k
        PQ, limits, norms = Q @ self.matrix[:-1], self.limit(Q, bounds, known), np.einsum("ij,ij->i", Q, Q)
        # Products of whole leaves are rounded otherwise than single ones: they get this room, and what passes is measured again.
        room = 4 * Q.shape[1] * EPS * np.sqrt(norms * np.einsum("ij,ij->i", X, X).max())
        PP, PPQ = np.einsum("ij,ij->i", P, P), np.einsum("ij,ij->i", PQ, PQ)
        near_room = 8 * PROJECTED * EPS * (PPQ + PP.max())
        need = np.where(known, bounds, -np.inf)
        walk = self.walk(tree, PQ, limits)
        listed = [self.leaves(walk, i, limits[i]) for i in range(len(Q))]
        lengths = np.array([len(x) for x, _ in listed])
        of = np.repeat(np.arange(len(Q)), lengths)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        leaf, away = (np.concatenate(x) for x in zip(*listed, strict=True))
        got_at, got_ids, got = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        met, stride = 0, 4
        while met < lengths.max():
            now = np.flatnonzero((turn >= met) & (turn < met + stride) & (away <= limits[of]))
            met, stride = met + stride, stride * 2
            if not len(now):
                break
            now = now[np.argsort(leaf[now], kind="stable")]
            asked = np.split(of[now], np.flatnonzero(np.diff(leaf[now])) + 1)
            some_at, some_rows = [], []
            for at, node in zip(asked, np.unique(leaf[now]).tolist(), strict=True):
                rows = slice(tree.start[node], tree.end[node])
                near = PPQ[at, None] + PP[rows] - 2 * (PQ[at] @ P[rows].T)
                score = Q[at] @ X[rows].T
                y, x = np.nonzero(~((near > (limits + near_room)[at, None]) | (score < (need - room)[at, None])) & open_[rows])
                some_at.append(at[y])
                some_rows.append(x + tree.start[node])
            at, rows = np.concatenate(some_at), np.concatenate(some_rows)
            other = ids[rows] != query_ids[at]
            at, rows = at[other], rows[other]
            step = max(1, VERIFIED_VALUES // Q.shape[1])
            score = np.concatenate([np.empty(0), *((X[rows[i : i + step]] * Q[at[i : i + step]]).sum(1) for i in range(0, len(rows), step))])
            enough = score >= need[at]
            got_at, got_ids, got = np.concatenate([got_at, at[enough]]), np.concatenate([got_ids, ids[rows[enough]]]), np.concatenate([got, score[enough]])
            order = np.lexsort((got_ids, -got, got_at))
            got_at, got_ids, got = got_at[order], got_ids[order], got[order]
            rank = np.arange(len(got)) - np.searchsorted(got_at, got_at)
            kth = rank == k - 1
            need[got_at[kth]] = got[kth]
            limits[got_at[kth]] = np.minimum(limits[got_at[kth]], self.farthest(norms[got_at[kth]], got[kth]))
            got_at, got_ids, got = got_at[rank < k], got_ids[rank < k], got[rank < k]
        return got_at, got_ids, got


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, confidence: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score double) of each query's k largest inner products found."""
    data = valid_vectors(vectors, id_col, vec_col).filter(F.exists("v", lambda x: x != 0))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    peaks = {r["dims"]: r["peak"] for r in data.groupBy(F.size("v").alias("dims")).agg(F.max(square).alias("peak")).collect()}
    return top_of_all(data, is_query, k, lambda sample: ProjectedSearch(sample.shape[1], peaks.get(sample.shape[1], 1.0), confidence=confidence), shard_rows)
