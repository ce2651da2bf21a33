"""Vector searches against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ann, topk_search
from tidemark.llm import vectors as vectors_module

SCHEMA = "vec_id long, embedding array<float>, q boolean, score int"


def vectors(spark, n=300, dims=16, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(30)] + [(5, rows[9][1]), (5, rows[9][1])]
    rows += [(1000, None), (1001, [0.0] * dims), (1002, [math.nan] + [0.0] * (dims - 1)), (1003, [None] + [1.0] * (dims - 1)), (1004, [math.inf] * dims), (None, rows[1][1])]
    return spark.createDataFrame([(i, v, False, 3) for i, v in rows], SCHEMA), rows


def usable(rows, zero):
    out = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out.append((i, np.array(v, np.float32).astype(float)))
    return out


def brute(rows, is_query, k, score):
    out = set()
    for q, x in {(i, tuple(v)) for i, v in rows if is_query(i)}:
        best = sorted((-score(np.array(x), v), i) for i, v in rows if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_exact_top_k_equals_brute_force(spark, monkeypatch):
    df, rows = vectors(spark)
    ints = [(i, np.floor(v * 1024).astype(np.int64)) for i, v in usable(rows, True)]
    want = brute(ints, lambda i: i % 10 == 0, 10, lambda a, b: int(a @ b))
    for shard, block in ((8192, 256), (50, 7)):
        monkeypatch.setattr(vectors_module, "BLOCK_QUERIES", block)
        monkeypatch.setattr(vectors_module, "GROUP_QUERIES", block)
        got = topk_search.exact_top_k(df, F.col("vec_id") % 10 == 0, 10, shard_rows=shard)
        assert {tuple(x) for x in got.collect()} == want


def test_huge_components_stay_exact():
    ids, x = np.arange(4), np.array([[2.0**40, 1], [2.0**40, 2], [-(2.0**40), 3], [1, 1]])
    search = topk_search.ThresholdSearch()
    at, found, score = search.run(search.prepare(ids, x), ids[:1], np.array([[2.0**20, 1.0]]), np.zeros(1, np.int64), np.zeros(1, bool), 2)
    assert found.tolist() == [1, 3] and score.tolist() == [2**60 + 2, 2**20 + 1]


def test_neighbours_reach_the_recall(spark):
    df, rows = vectors(spark, 2000, 32)
    good = usable(rows, False)
    want = {(q, i) for q, _, i, _ in brute(good, lambda i: i % 20 == 0, 20, lambda a, b: float(a @ b))}
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20, shard_rows=500).collect()
    assert len({(x["query_id"], x["vec_id"]) for x in got} & want) >= 0.9 * len(want)
    by_id = dict(good)
    for x in got[:200]:
        if x["vec_id"] != 5:
            assert abs(x["score"] - float(by_id[x["query_id"]] @ by_id[x["vec_id"]])) < 1e-9


def test_copies_rank_by_id(spark):
    df, _ = vectors(spark)
    got = ann.nearest_neighbours(df, F.col("vec_id") == 7, 20).orderBy("rank").collect()
    assert [x["vec_id"] for x in got] == list(range(300, 320))


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0], True, 1), (3, [1.0, 1.0], True, 1), (40, [1.0], True, 1)], SCHEMA)
    for search in (ann.nearest_neighbours, topk_search.exact_top_k):
        assert [(x["query_id"], x["vec_id"]) for x in search(df, F.col("vec_id") % 20 == 0).collect()] == [(20, 3)]
        assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square_quantile():
    assert abs(ann.chi_square_quantile(0.95, 8) - 15.507) < 0.001
    assert abs(ann.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-6


def test_the_stopping_test_leaves_rows_of_other_clusters_unread():
    r = np.random.default_rng(5)
    centers = r.normal(0, 1, (40, 32))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True) / 6
    X = centers[r.integers(0, 40, 8000)] + r.normal(0, 0.05, (8000, 32))
    ids, peak = np.arange(8000), float((X**2).sum(1).max())
    search = ann.ProjectedSearch(32, peak)
    index = search.prepare(ids, X)
    read = []
    whole = search.leaves
    search.leaves = lambda tree, p, limit: (lambda x: (read.append(sum(tree.end[i] - tree.start[i] for i in x[0])), x)[1])(whole(tree, p, limit))
    Q = X[::100]
    scores = Q @ X.T
    scores[np.arange(len(Q)), ids[::100]] = -np.inf
    kth = np.sort(scores, axis=1)[:, -20]
    of, found, _ = search.run(index, ids[::100], Q, kth, np.ones(len(Q), bool), 20)
    want = {(i, j) for i in range(len(Q)) for j in np.argsort(-scores[i])[:20].tolist()}
    assert len(want & set(zip(of.tolist(), found.tolist(), strict=True))) >= 0.9 * len(want)
    assert 0 < np.mean(read) < 4000
    low, high = (np.stack([f(search.coordinates(centers[c : c + 1] + 0.2 * s), axis=0) for c in range(40)]) for f, s in ((np.min, -1), (np.max, 1)))
    low, high = np.minimum(low, high), np.maximum(low, high)
    assert search.reach(low, high, Q, kth, np.ones(len(Q), bool)).mean() < 1


class Counted(np.ndarray):
    """Counts the rows that are taken out one by one."""

    taken = 0

    def __getitem__(self, key):
        if isinstance(key, np.ndarray):
            Counted.taken += len(key)
        return super().__getitem__(key)


def test_a_block_of_queries_measures_few_pairs_singly_and_finds_what_single_queries_find():
    r = np.random.default_rng(3)
    X = r.normal(0, 1, (4096, 64)) / 8
    X[1000:1100] = X[32]
    ids, at = r.permutation(4096), np.arange(0, 4096, 16)
    search = ann.ProjectedSearch(64, float((X**2).sum(1).max()))
    index = search.prepare(ids, X)
    index = (index[0], index[1].view(Counted), *index[2:])
    kth = np.sort([(X * q).sum(1) for q in X[at]], axis=1)[:, -40]
    for bounds, known in ((np.zeros(256), np.zeros(256, bool)), (kth, np.arange(256) % 8 > 0)):
        found = []
        for block in (256, 1):
            Counted.taken = 0
            parts = [search.run(index, ids[at[i : i + block]], X[at[i : i + block]], bounds[i : i + block], known[i : i + block], 20) for i in range(0, 256, block)]
            found.append([(q + i * block, j, s) for i, part in enumerate(parts) for q, j, s in zip(*(x.tolist() for x in part), strict=True)])
            assert Counted.taken < 0.2 * 256 * 4096
        assert found[0] == found[1]
        assert [j for q, j, _ in found[0] if q == 2] == sorted(ids[1000:1100].tolist())[:20]


def test_copies_of_the_longest_vector_are_few_to_measure_and_all_in_reach():
    r = np.random.default_rng(4)
    X = r.normal(0, 1, (3000, 64)) / 8
    X[:2000] = X[0] * 3
    ids, peak = r.permutation(3000), float(sum(x * x for x in X[0].tolist()))
    ids[[10, 20, 30]] = ids[5]
    search = ann.ProjectedSearch(64, peak)
    index = search.prepare(ids, X)
    index = (index[0], index[1].view(Counted), *index[2:])
    Q, own = X[:64], np.full(64, (X[0] * X[0]).sum())
    low = high = search.coordinates(X[:1])[0][None]
    assert search.reach(low, high, Q, own, np.ones(64, bool)).all()
    for known in (np.zeros(64, bool), np.ones(64, bool)):
        Counted.taken = 0
        of, found, _ = search.run(index, ids[:64], Q, own, known, 20)
        assert Counted.taken < 0.2 * 64 * 2000
        for i in range(64):
            assert found[of == i].tolist() == sorted(x for x in ids[:2000].tolist() if x != ids[i])[:20]


def test_top_k_skips_cells_whose_corner_cannot_reach():
    search = topk_search.ThresholdSearch()
    low, high = np.array([[0.0, 0.0], [8.0, 8.0]]), np.array([[1.0, 1.0], [9.0, 9.0]])
    got = search.reach(low, high, np.array([[1.0, 1.0], [-1.0, 0.0]]), np.array([17, -1]), np.array([True, True]))
    assert got.tolist() == [[False, True], [True, False]]
    assert search.reach(low, high, np.ones((1, 2)), np.zeros(1, np.int64), np.array([False])).all()
