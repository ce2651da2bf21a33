"""Boundary cases and plans of the base library's operators."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import periods as P
from tidemark.operators import relational as R
from tidemark.operators import temporal as T
from tidemark.plans import generator, inspect, layouts, matrix
from tidemark.sources import files

DAY = datetime(2020, 1, 1)
SCHEMA = "id int, attr int, lo timestamp_ntz, hi timestamp_ntz"


def at(n):
    return None if n is None else DAY + timedelta(days=n)


def table(spark, rows):
    return spark.createDataFrame([(i, a, at(lo), at(hi)) for i, (a, lo, hi) in enumerate(rows)], SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def day(n):
    return F.lit(at(n)).cast("timestamp_ntz")


def test_touching_rows_match_boxes_but_not_ranges(spark):
    df = table(spark, [(1, 0, 3), (1, 3, 5), (1, 5, None), (2, 0, 9)])
    assert ids(df.filter((F.col("attr") == 1) & P.range_overlaps("lo", "hi", day(1), day(3)))) == [0]
    assert ids(df.filter(P.box_overlaps("attr", "lo", "hi", F.lit(1), day(1), day(3)))) == [0, 1]


def test_empty_and_open_periods(spark):
    df = table(spark, [(1, 2, 2), (1, 2, None), (1, 0, 9)])
    assert ids(df.filter(P.range_overlaps("lo", "hi", day(0), None))) == [1, 2]
    assert ids(df.filter(P.box_contained_by("attr", "lo", "hi", F.lit(1), day(0), day(9)))) == [0, 2]
    assert ids(df.filter(P.is_current("hi"))) == [1]


ALLEN = {
    "before": (0, 1, 2, 3), "meets": (0, 2, 2, 3), "overlaps": (0, 2, 1, 3), "finished_by": (0, 3, 1, 3), "contains": (0, 9, 1, 3), "starts": (0, 2, 0, 3), "equals": (0, 2, 0, 2),
    "started_by": (0, 3, 0, 2), "during": (1, 2, 0, 3), "finishes": (1, 3, 0, 3), "overlapped_by": (1, 3, 0, 2), "met_by": (2, 3, 0, 2), "after": (4, 5, 0, 2),
}


def test_allen_relations(spark):
    rows = [(n, *(at(x) for x in v)) for n, v in ALLEN.items()] + [("equals", at(0), None, at(0), None), ("starts", at(0), at(1), at(0), None), ("finishes", at(1), None, at(0), None), ("contains", at(0), None, at(1), at(2))]
    df = spark.createDataFrame(rows, "want string, a timestamp_ntz, b timestamp_ntz, c timestamp_ntz, d timestamp_ntz")
    for r in df.select("want", P.allen("a", "b", "c", "d").alias("got")).collect():
        assert r["want"] == r["got"]


@pytest.mark.parametrize("bucket", [1, 3, 50])
def test_overlap_join_equals_nested_loop(spark, bucket):
    rows = [(i % 3, i * 2 % 17, None if i % 7 == 0 else i * 2 % 17 + i % 5) for i in range(40)]
    df = table(spark, rows)
    got = {(r["l_id"], r["r_id"]) for r in T.overlap_join(df, df, bucket, ["attr"]).collect()}
    far = 10**6
    live = [(i, a, lo, far if hi is None else hi) for i, (a, lo, hi) in enumerate(rows) if hi is None or hi > lo]
    assert got == {(i, j) for i, a, l1, h1 in live for j, b, l2, h2 in live if a == b and l1 < h2 and l2 < h1}


def test_coalesce_and_subtract(spark):
    df = table(spark, [(1, 0, 2), (1, 2, 4), (1, 6, 8), (2, 0, None), (2, 5, 7), (3, 1, 1)])
    got = sorted((r["attr"], r["lo"], r["hi"]) for r in T.coalesce_periods(df, ["attr"]).collect())
    assert got == [(1, at(0), at(4)), (1, at(6), at(8)), (2, at(0), None)]
    cut = table(spark, [(1, 1, 7), (2, 3, 4)])
    got = sorted((r["attr"], r["lo"], r["hi"] or at(999)) for r in T.subtract_periods(df, cut, ["attr"]).collect())
    assert got == [(1, at(0), at(1)), (1, at(7), at(8)), (2, at(0), at(3)), (2, at(4), at(999))]


def test_null_aware_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    some, empty, nulls = (spark.createDataFrame(x, "b int") for x in ([(2,)], [], [(2,), (None,)]))
    assert [r[0] for r in R.not_in(left, "a", some, "b").collect()] == [1]
    assert R.not_in(left, "a", empty, "b").count() == 3
    assert R.not_in(left, "a", nulls, "b").count() == 0


def test_filters_reach_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_totalprice > 1000").select("o_orderkey")
    assert "o_totalprice" in inspect.pushed_filters(df)[0]
    assert set(inspect.read_columns(df)[0]) == {"o_orderkey", "o_totalprice"}
    counters = inspect.Counters()
    counters.see(df)
    assert counters.stats["scans"] == 1 and counters.stats["pruned"] == 1 and counters.stats["shuffles"] == 0


def test_a_keyed_overlap_join_has_no_nested_loop(spark, sf_dir):
    df = table(spark, [(1, 0, 3)])
    found = inspect.operators(T.overlap_join(df, df, 1, ["attr"]))
    assert not any("Cartesian" in k for k in found)
    # Those that take the other side's last bucket, a table of one row.
    assert sum(n for k, n in found.items() if "NestedLoop" in k) == 2


@pytest.mark.parametrize("layout", layouts.LAYOUTS)
def test_layouts_keep_all_rows_and_skip_some(spark, tmp_path, layout):
    df = generator.generate(spark, 4000, "history_skew").unionByName(generator.generate(spark, 400, "long_tailed"))
    path = str(tmp_path / layout)
    layouts.write_layout(df, path, layout, 6)
    back = layouts.read_layout(spark, path).select(*df.columns)
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    found = layouts.layout_metrics(spark, path).first()
    assert found["rows"] == 4400 and found["bytes"] > 0 and found["current_rows"] == df.filter("hi IS NULL").count()
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2030-01-01", "2030-01-05"))
    attr = 10 if layout in ("btree", "gist_attr_period", "temporal_rtree") else None
    got = layouts.overlapping(spark, path, layout, a, b, attr).select("id", "lo", "hi")
    want = df.filter(P.range_overlaps("lo", "hi", a, b) if attr is None else P.box_overlaps("attr", "lo", "hi", F.lit(10), a, b)).select("id", "lo", "hi")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    scanned = layouts.rows_scanned(got)
    assert scanned == 4400 if layout == "no_index" else scanned < 4000


def test_copy_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None), (3, "")], "i int, s string")
    for fmt in ("csv", "text"):
        files.copy_to(df, str(tmp_path / fmt), fmt, header=fmt == "csv")
        back = files.copy_from(spark, str(tmp_path / fmt), "i int, s string", fmt, header=fmt == "csv")
        assert [(r["i"], r["s"]) for r in back.orderBy("i").collect()][:2] == [(1, 'a,"b"'), (2, None)]


def test_generator_is_independent_of_partitions(spark):
    one = generator.generate(spark, 300, "long_tailed")
    two = one.repartition(7)
    assert one.exceptAll(two).isEmpty()


def test_connect_by_follows_deep_chains_and_refuses_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 41)], "id long, up long")
    assert sorted(r["level"] for r in R.connect_by(chain, "id", "up", F.col("id") == 1).collect()) == list(range(40))
    assert R.connect_by(chain, "id", "up", F.col("id") == 1, max_depth=3).count() == 4
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, up long")
    with pytest.raises(ValueError):
        R.connect_by(ring, "id", "up", F.col("id") == 1)


def test_merge_refuses_to_change_a_row_twice(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n")], "k int, v string")
    with pytest.raises(ValueError):
        R.merge(target, source, ["k"], [(None, {"v": F.col("s.v")})])
    one = R.merge(target, source, ["k"], [(F.col("s.v") == "y", {"v": F.col("s.v")}), (None, "nothing")], [(None, {})])
    assert sorted((r["action"], r["k"] or 0, r["v"]) for r in one.collect()) == [("insert", 0, "n"), ("insert", 3, "z"), ("keep", 0, "c"), ("keep", 2, "b"), ("update", 1, "y")]
    kept = R.merge(target, source, ["k"], [(None, "nothing")])
    assert sorted(r["v"] for r in kept.collect()) == ["a", "b", "c"]


def test_on_conflict(spark):
    target = spark.createDataFrame([(1, "a"), (None, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "n")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in R.after(R.insert_on_conflict(target, new, ["k"])).collect()) == [(0, "c"), (0, "n"), (1, "a"), (2, "y")]
    with pytest.raises(ValueError):
        R.insert_on_conflict(target, new, ["k"], {"v": F.col("s.v")})


def test_top_with_ties_keeps_peers_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, None), (5, None)], "id int, v int")
    assert sorted(r["id"] for r in R.top_with_ties(df, 1, [(F.col("v"), "desc")]).collect()) == [1, 2]
    assert sorted(r["id"] for r in R.top_with_ties(df, 1, [(F.col("v"), "asc_nulls_first")]).collect()) == [4, 5]


def test_one_key_is_spread_over_its_buckets(spark):
    """A single attribute: the same results whatever the buckets, and no task with more than a bucket's rows."""
    import random

    r = random.Random(3)
    rows = [(1, lo, lo + r.randint(0, 9) if r.random() < 0.97 else None) for lo in sorted(r.randint(0, 2000) for _ in range(600))]
    rows += [(None, lo, lo + 2) for lo in (5, 6, 900)]
    df = table(spark, rows)
    cut = table(spark, [(1, lo, lo + 3) for lo in range(0, 2000, 40)] + [(None, 6, 7)])
    for f in (lambda b: T.coalesce_periods(df, ["attr"], b), lambda b: T.timeline(df, ["attr"], b), lambda b: T.overlap_violations(df, ["attr"], "id", b), lambda b: T.subtract_periods(df, cut, ["attr"], b)):
        whole, parts = f(100_000), f(7)
        assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty() and whole.count() > 3
    live = sorted((lo, 10**6 if hi is None else hi) for a, lo, hi in rows if a == 1 and (hi is None or hi > lo))
    runs = []
    for lo, hi in live:
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    got = sorted((x["lo"], x["hi"] or at(10**6)) for x in T.coalesce_periods(df, ["attr"], 7).filter("attr = 1").collect())
    assert got == [(at(lo), at(hi)) for lo, hi in runs]
    sizes = T._bucketed(df, ["attr"], "lo", 7).groupBy("__key", "__b").count().agg(F.max("count")).first()[0]
    assert sizes <= 20


def test_asof_join_across_buckets(spark):
    left = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate([(1, 5), (1, 400), (1, 2), (2, 9), (None, 9), (1, None)])], "id int, k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(3), "a"), (1, at(3), "b"), (1, at(5), "c"), (2, at(10), "d"), (None, at(1), "e")], "rk int, rt timestamp_ntz, v string")
    for days in (1, 10_000):
        got = {r["id"]: r["v"] for r in T.asof_join(left, right, "t", "rt", "k", "rk", ["v"], days).collect()}
        assert got == {0: "c", 1: "c", 2: None, 3: None, 4: None, 5: None}


def test_long_periods_are_posted_a_few_times(spark):
    df = table(spark, [(1, 0, 5000), (1, 4999, 5001), (1, 20, 21), (1, 4000, None)])
    got = {(r["l_id"], r["r_id"]) for r in T.overlap_join(df, df, 1, ["attr"]).collect()}
    assert got == {(i, i) for i in range(4)} | {(0, 1), (1, 0), (0, 2), (2, 0), (0, 3), (3, 0), (1, 3), (3, 1)}


def test_the_workload_runs_over_every_layout(spark, tmp_path):
    took = matrix.run(spark, str(tmp_path), 2000)
    assert len(took) == 4 * len(layouts.LAYOUTS)
    data = generator.generate(spark, 2000)
    whole = data.unionByName(matrix.new_rows(spark, 2000))
    for layout in layouts.LAYOUTS:
        for name, change in (("updated", matrix.updated), ("deleted", matrix.deleted)):
            got = layouts.read_layout(spark, str(tmp_path / f"{layout}_{name}")).select(*whole.columns)
            assert got.count() == change(whole).count() and got.exceptAll(change(whole)).isEmpty()


def test_a_stream_closes_out_periods_batch_by_batch(spark, tmp_path):
    from tidemark.streaming import operators as S

    current = spark.createDataFrame([("a", at(0), None), ("b", at(1), None), ("c", at(0), at(1))], "key string, lo timestamp_ntz, hi timestamp_ntz")
    source = tmp_path / "in"
    for i, batch in enumerate([[("a", at(5)), ("d", at(6))], [("a", at(9))]]):
        spark.createDataFrame(batch, "key string, at timestamp_ntz").coalesce(1).write.mode("append").parquet(str(source))
    stream = S.file_stream(spark, str(source), "key string, at timestamp_ntz", files_per_trigger=1)
    got = {(r["key"], r["lo"], r["hi"]) for r in S.close_out(stream, current, "key", "at", str(tmp_path / "table")).collect()}
    assert got == {("a", at(0), at(5)), ("a", at(5), at(9)), ("a", at(9), None), ("b", at(1), None), ("c", at(0), at(1)), ("d", at(6), None)}


def test_pages_are_skipped_and_kept_true(spark, tmp_path):
    from tidemark.plans.pages import PageIndex

    df = generator.generate(spark, 3000, "history_skew")
    index = PageIndex(spark, str(tmp_path / "index"))
    index.build(df, 6)
    index.insert(generator.generate(spark, 200, "balanced").withColumn("id", F.col("id") + 10_000))
    whole = df.unionByName(generator.generate(spark, 200, "balanced").withColumn("id", F.col("id") + 10_000))
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2024-03-01", "2024-03-05"))
    for operator, same in P.BOX_OPERATORS.items():
        for attr in (10, 500):
            assert ids(index.scan(a, b, attr, operator)) == ids(whole.filter(same("attr", "lo", "hi", F.lit(attr), a, b)))
    assert index.stats["scans"] == 6 and 0 < index.stats["pages_read"] < index.stats["pages_skipped"]
    boxes = {r["page"]: r for r in index.pages().collect()}
    assert {r["kind"] for r in boxes.values()} == {"CURRENT", "HISTORY"} and sum(r["rows"] for r in boxes.values()) == 3200
    near, far = index.estimate(a, b, 10), PageIndex(spark, str(tmp_path / "index"), force=True).estimate(a, b, 10)
    assert near["pages"] < len(boxes) and far["cost"] == pytest.approx(near["cost"] * 0.05)
    changed = index.bulk_delete((F.col("attr") == 10) & F.col("hi").isNotNull())
    assert 0 < changed < len(boxes) and ids(index.rows()) == ids(whole.filter("NOT (attr = 10 AND hi IS NOT NULL)"))
    assert index.bulk_delete(F.col("attr") == 999) == 0
    index.reset_stats()
    assert not index.stats


def test_penalties_and_splits():
    from tidemark.plans import pages

    box = pages.Box
    history, current = box(1, 5, 0, 10**12), box(1, 5, 0, None)
    grown = pages.penalty(history, box(1, 9, 0, 10**12))
    assert grown == pytest.approx(10**12 / pages.TIME_MAX * 4 / 99)
    assert pages.penalty(current, box(1, 9, 0, None)) == pytest.approx(0.5 * (box(1, 9, 0, None).area() - current.area()))
    assert pages.penalty(history, current) == pytest.approx(2 * (current.area() - history.area()))
    still = [box(i, i, t, None) for i, t in enumerate((0, 1, 2, 100, 101))]
    assert pages.pick_split(still) == ([0, 1, 2], [3, 4])
    assert pages.pick_split([box(1, 1, 7, None)] * 3) == ([0, 1], [2])
    mixed = [box(1, 1, 0, 10), box(90, 90, 10**14, 10**14 + 5), box(2, 2, 5, 20), box(88, 88, 10**14 - 9, 10**14)]
    assert [sorted(s) for s in pages.pick_split(mixed)] == [[0, 2], [1, 3]]
    assert pages.kind(still) == "CURRENT" and pages.kind([history]) == "HISTORY" and pages.kind([history, current]) == "MIXED"


def test_a_lateral_limit_ranks_by_its_order(spark, sf_dir):
    """The rank carries the order itself; a sort before a shuffle does not survive it."""
    from tidemark import queries

    plan = queries.queries()["j_lateral"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "row_number()" in line)
    assert "o_totalprice" in window and "DESC" in window and "+- Sort" not in plan


@pytest.mark.parametrize("bucket", [1, 50])
def test_overlap_totals_equal_those_of_the_pairs(spark, bucket):
    """Nulls and empty periods included; the plan makes no pairs."""
    rows = [(i % 3 if i % 11 else None, i * 2 % 17, None if i % 7 == 0 else i * 2 % 17 + i % 5) for i in range(60)] + [(1, None, None), (1, None, 4), (2, 90, 95)]
    left = table(spark, rows).withColumn("id", F.floor(F.col("id") / 2))
    right = table(spark, rows[::2]).withColumn("id", F.when(F.col("id") % 3 > 0, F.col("id")))
    live = F.expr("(l_hi IS NULL OR l_hi > l_lo) AND (r_hi IS NULL OR r_hi > r_lo) AND (r_hi IS NULL OR l_lo < r_hi) AND (l_hi IS NULL OR r_lo < l_hi)")
    l, r = (df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns]) for df, p in ((left, "l_"), (right, "r_")))
    for on in ([], ["attr"]):
        pairs = l.join(r, [live, *[F.col(f"l_{c}") == F.col(f"r_{c}") for c in on]])
        want = pairs.groupBy("l_id").agg(F.count("*").alias("n"), F.sum("r_id").alias("r_id"))
        got = T.overlap_totals(left, right, "id", on, ["id"], bucket)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 5


def test_interval_queries_make_no_pairs(spark, sf_dir):
    from tidemark import queries

    for name in ("t_interval_join", "t_interval_join_keyed"):
        plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Join Inner, .* [<>]=? ", plan)


def test_drained_results_stay_out_of_the_driver(spark, tmp_path):
    from tidemark.streaming import operators as S

    source = tmp_path / "in"
    for n in (3, 5):
        spark.range(n).coalesce(1).write.mode("append").parquet(str(source))
    stream = lambda: S.file_stream(spark, str(source), "id long", files_per_trigger=1)
    totals, rows = S.drain(stream().groupBy("id").count()), S.drain(stream(), "append")
    assert sorted(map(tuple, totals.collect())) == [(0, 2), (1, 2), (2, 2), (3, 1), (4, 1)]
    assert sorted(r[0] for r in rows.collect()) == [0, 0, 1, 1, 2, 2, 3, 4]
    (tmp_path / "none").mkdir()
    assert S.drain(S.file_stream(spark, str(tmp_path / "none"), "id long"), "append").count() == 0
    for df in (totals, rows):
        assert len(df.inputFiles()) and "MemoryPlan" not in df._jdf.queryExecution().analyzed().toString()
