"""Exact top-k by Fagin's threshold algorithm over sorted per-dimension lists.

Components become floor(scale * x) as integers; the score is their inner
product. In each shard every dimension has a list of the rows sorted by that
component. A query walks its lists from their best end for it, in strides
that double; rows met for the first time are scored in full by random
access, and the walk stops once the sum of the lists' current contributions,
which bounds every row not yet met, cannot equal the kth score. A row whose
score ties with the kth is therefore always met, so ties go to the smaller id
exactly. A query takes its kth score of one shard to the others, and visits
only those cells whose box, by the same sum at its best corner, reaches it
(vectors.py).

On vectors without structure the sum falls slowly, so that most rows of a shard
are met before the walk may stop.

Null vectors and vectors that hold null or non-finite components take no part.
A row never answers a query with its own vec_id. Repeated rows are rows of
their own as candidates; as queries they count once. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Search, best, top_of_all, valid_vectors


def _exact_product(X: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
    """Integer inner products; float64 is exact while every partial sum stays under 2**53."""
    if small:
        return (X @ q).astype(np.int64)
    return X.astype(np.int64) @ q.astype(np.int64)


class ThresholdSearch(Search):
    score_type = "long"

    def __init__(self, stride: int = 32):
        self.stride = stride

    def coordinates(self, X: np.ndarray) -> np.ndarray:
        return X

    def reach(self, low: np.ndarray, high: np.ndarray, Q: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> np.ndarray:
        most = np.maximum(Q, 0) @ high.T + np.minimum(Q, 0) @ low.T
        # Room for the rounding of sums over 2 ** 53.
        return ~known[:, None] | (most * (1 + 1e-9 * np.sign(most)) + 1 >= bounds[:, None])

    def prepare(self, ids: np.ndarray, X: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by_id = np.argsort(ids, kind="stable")
        return ids[by_id], X[by_id], np.argsort(X[by_id], axis=0, kind="stable")

    def run(self, index: tuple, query_ids: np.ndarray, Q: np.ndarray, bounds: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, X, order = index
        n, dims = X.shape
        small = float(np.abs(X).max(initial=0)) * float(np.abs(Q).max(initial=0)) * dims < 2**53
        out_at, out_ids, out_scores = [], [], []
        every = np.arange(dims)
        for i, (qid, q) in enumerate(zip(query_ids, Q, strict=True)):
            live = every[q != 0]
            rising = q[live] < 0
            done = np.zeros(n, bool)
            got_ids, got = np.empty(0, np.int64), np.empty(0, np.int64)
            depth, step_rows = 0, self.stride
            while depth < n:
                end = min(depth + step_rows, n)
                step = np.arange(depth, end)
                if len(live):
                    rows = order[np.where(rising[None, :], step[:, None], n - 1 - step[:, None]), live[None, :]]
                else:
                    rows = step
                seen = np.zeros(n, bool)
                seen[rows] = True
                new = np.flatnonzero(seen & ~done)
                done[new] = True
                new = new[ids[new] != qid]
                if len(new):
                    score = _exact_product(X[new], q, small)
                    if known[i]:
                        new, score = new[score >= bounds[i]], score[score >= bounds[i]]
                    got_ids, got = np.concatenate([got_ids, ids[new]]), np.concatenate([got, score])
                    keep = best(got_ids, got, k)
                    got_ids, got = got_ids[keep], got[keep]
                kth = got[-1] if len(got) == k else bounds[i] if known[i] else None
                if len(live) and kth is not None:
                    last = X[rows[-1], live] * q[live]
                    if (last.sum() if small else sum(map(int, last))) < kth:
                        break
                depth, step_rows = end, step_rows * 2
            out_at.append(np.full(len(got), i))
            out_ids.append(got_ids)
            out_scores.append(got)
        return np.concatenate(out_at), np.concatenate(out_ids), np.concatenate(out_scores)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score long) of each query's k largest integer inner products."""
    data = valid_vectors(vectors, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    return top_of_all(data, is_query, k, lambda sample: ThresholdSearch(), shard_rows)


#: DuckDB SQL for k = 10, scale = 1024 and the queries divisible by 100.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 10
"""
