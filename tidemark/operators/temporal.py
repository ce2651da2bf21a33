"""Operators over tables of periods, as DataFrame plans.

Joins on overlap become equi-joins on time buckets with a residual predicate,
so they shuffle by (key, bucket) instead of comparing all pairs. Open-ended
rows are joined apart, with the buckets in which the other side ends.

What runs along a key's time line (reaches, counts, last values) is computed
per (key, bucket) first; then one row of each bucket is carried along the key,
and joined back. So a key of very many rows is spread over its buckets, and
what one task holds is bounded by a bucket's rows, not a key's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .periods import ends_after, is_empty, range_overlaps

US = 1_000_000
DAY_US = 86_400 * US
FAR = "9999-12-31 23:59:59.999999"
#: Levels of bucket widths in overlap_join, each so many times the one before.
LEVELS, STEP = 6, 8


def micros(t: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.unix_micros(t.cast("timestamp"))


def _bucketed(df: DataFrame, by: list[str], at: str, bucket_days: float) -> DataFrame:
    """df with __key (never null, whatever `by` holds) and __b, the time bucket of column `at`."""
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    return df.withColumn("__key", key).withColumn("__b", F.floor(micros(F.col(at)) / int(bucket_days * DAY_US)))


def _along(order: list[str]) -> Window:
    """A window along a bucket of a key."""
    return Window.partitionBy("__key", "__b").orderBy(*order)


def _carried(rows: DataFrame, states: dict[str, tuple[Column, Callable[[str], Column]]], forward: bool = True) -> DataFrame:
    """rows with a column per state: of each bucket an aggregate, folded over all earlier (or all later) buckets of its key."""
    per = rows.groupBy("__key", "__b").agg(*[total.alias(name) for name, (total, _) in states.items()])
    w = Window.partitionBy("__key").orderBy("__b" if forward else F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(per.select("__key", "__b", *[fold(name).over(w).alias(name) for name, (_, fold) in states.items()]), ["__key", "__b"])


def periods_from_events(df: DataFrame, key: str, at: str, tie: str, attr: Column) -> DataFrame:
    """Each row is valid from its time to the next one of its key; the last one still is."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return df.withColumn("hi", F.lead(at).over(w)).withColumn("lo", F.col(at)).withColumn("attr", attr)


def overlap_join(left: DataFrame, right: DataFrame, bucket_days: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose half-open periods overlap; columns of the sides are l_* and r_*.

    Both sides have lo, hi and the columns of `on`. A finite row belongs to the
    level of bucket widths on which it touches a few buckets only, and is posted
    under those it touches there and on every coarser level; a pair meets on the
    coarser of its two levels, in the bucket of the later of its starts, so once.
    A row without end meets the other side's finite rows in the buckets in which
    they end, from its start to the last one; two rows without end always overlap.
    """
    on = on or []
    width = int(bucket_days * DAY_US)

    def side(df: DataFrame, p: str) -> DataFrame:
        df = df.filter(~is_empty("lo", "hi"))
        first, last = F.floor(micros(F.col("lo")) / width), F.floor((micros(F.col("hi")) - 1) / width)
        spans = F.greatest(F.col(f"__{p}last") - F.col(f"__{p}first"), F.lit(1))
        level = F.least(F.floor(F.log(float(STEP), spans.cast("double")) + 1e-9), F.lit(LEVELS - 1)).cast("int")
        named = df.select(first.alias(f"__{p}first"), last.alias(f"__{p}last"), *[F.col(c).alias(f"{p}{c}") for c in df.columns])
        return named.withColumn(f"__{p}level", level)

    a, b = side(left, "l_"), side(right, "r_")
    keys = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in on]

    def posted(df: DataFrame, p: str) -> DataFrame:
        """A row for each level from its own on and each bucket there: __level, __b, and its first bucket there."""
        scale = F.pow(F.lit(float(STEP)), F.col("__level")).cast("long")
        down = lambda x: F.floor(F.col(x) / scale)
        df = df.filter(F.col(f"{p}hi").isNotNull()).withColumn("__level", F.explode(F.sequence(F.col(f"__{p}level"), F.lit(LEVELS - 1))))
        df = df.withColumn(f"__{p}at", down(f"__{p}first")).withColumn("__b", F.explode(F.sequence(down(f"__{p}first"), down(f"__{p}last"))))
        return df.withColumnsRenamed({"__level": f"__{p}on", "__b": f"__{p}b"})

    both = range_overlaps("l_lo", "l_hi", F.col("r_lo"), F.col("r_hi"))
    met = [F.col("__l_on") == F.col("__r_on"), F.col("__l_b") == F.col("__r_b"), *keys, both]
    once = [F.col("__l_on") == F.greatest("__l_level", "__r_level"), F.col("__l_b") == F.greatest("__l_at", "__r_at")]
    finite = posted(a, "l_").join(posted(b, "r_"), [*met, *once])

    def unending(still: DataFrame, p: str, ended: DataFrame, q: str) -> DataFrame:
        """Rows without end with the other side's finite rows that end after they start."""
        still, ended = still.filter(F.col(f"{p}hi").isNull()), ended.filter(F.col(f"{q}hi").isNotNull())
        end = ended.agg(F.max(f"__{q}last").alias("__end"))
        still = still.join(F.broadcast(end), F.col(f"__{p}first") <= F.col("__end"))
        still = still.withColumn("__b", F.explode(F.sequence(f"__{p}first", "__end"))).drop("__end")
        return still.join(ended, [F.col("__b") == F.col(f"__{q}last"), *keys, F.col(f"{q}hi") > F.col(f"{p}lo")])

    open_a, open_b = a.filter("l_hi IS NULL"), b.filter("r_hi IS NULL")
    z = open_a.join(open_b, keys) if keys else open_a.crossJoin(open_b)
    columns = [*[f"l_{c}" for c in left.columns], *[f"r_{c}" for c in right.columns]]
    out = finite.select(*columns)
    for part in (unending(a, "l_", b, "r_"), unending(b, "r_", a, "l_"), z):
        out = out.unionByName(part.select(*columns))
    return out


def overlap_totals(left: DataFrame, right: DataFrame, by: str, on: list[str] | None = None, sums: list[str] | None = None, bucket_days: float = 30) -> DataFrame:
    """overlap_join(left, right).groupBy(l_by) with the number of pairs (n) and totals of right integers (r_*), without its pairs.

    A right row overlaps a left one if it starts before that ends, and doesn't end by its start. None is empty, so the
    right rows that end by then are among those that start before: the number of pairs is a difference of two running
    totals along the right side's starts and ends, each read at one time of a left row. Work grows with the rows.
    """
    on, sums = on or [], sums or []
    live = F.col("hi").isNull() | (F.col("hi") > F.col("lo"))
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(c == "hi").alias("end")) for c in ("lo", "hi")])).alias("__e")
    edges = right.filter(live).select(*on, *sums, ends).select(*on, *sums, "__e.*")
    probes = left.filter(live).select(F.col(by).alias(f"l_{by}"), *[F.col(c).alias(f"__{c}") for c in on], ends).select(f"l_{by}", *[f"__{c}" for c in on], "__e.*")
    # What is counted of a right row: itself, and of each column to be summed its value and whether it has one.
    counted = {"n": F.lit(1).cast("long")}
    for c in sums:
        counted |= {f"sum_{c}": F.coalesce(F.col(c).cast("decimal(38,0)"), F.lit(0)), f"has_{c}": F.col(c).isNotNull().cast("long")}
    at = {f"lo_{m}": F.when(~F.col("end"), x) for m, x in counted.items()} | {f"hi_{m}": F.when(F.col("end") & F.col("t").isNotNull(), x) for m, x in counted.items()}
    edges = edges.select(*on, "t", *[F.coalesce(x, F.lit(0)).alias(m) for m, x in at.items()])
    asked = probes.select(*[F.col(f"__{c}").alias(c) for c in on], "t").distinct()
    times = edges.unionByName(asked.select("*", *[F.lit(0).cast(edges.schema[m].dataType).alias(m) for m in at])).groupBy(*on, "t").agg(*[F.sum(m).alias(m) for m in at])
    run = _along(["t"]).rowsBetween(Window.unboundedPreceding, 0)
    rows = _bucketed(times.filter("t IS NOT NULL"), on, "t", bucket_days).withColumns({f"__{m}": F.sum(m).over(run) for m in at})
    rows = _carried(rows, {f"__{m}0": (F.sum(m), F.sum) for m in at})
    # Starts before t, ends up to t; at no time, all.
    upto = {m: F.col(f"__{m}") + F.coalesce(f"__{m}0", F.lit(0)) - (F.col(m) if m.startswith("lo_") else F.lit(0)) for m in at}
    totals = rows.select(*on, "t", *[x.alias(m) for m, x in upto.items()])
    whole = times.groupBy(*on).agg(*[F.sum(m).alias(m) for m in at]).withColumn("t", F.lit(None).cast(rows.schema["t"].dataType))
    totals = totals.unionByName(whole).withColumnRenamed("t", "__t")
    met = probes.join(totals, [F.col("t").eqNullSafe(F.col("__t")), *[F.col(f"__{c}") == F.col(c) for c in on]])
    out = met.groupBy(f"l_{by}").agg(*[F.sum(F.when(F.col("end"), F.col(f"lo_{m}")).otherwise(-F.col(f"hi_{m}"))).alias(m) for m in counted]).filter("n > 0")
    return out.select(f"l_{by}", "n", *[F.when(F.col(f"has_{c}") > 0, F.col(f"sum_{c}")).cast("long").alias(f"r_{c}") for c in sums])


def stab_join(points: DataFrame, periods: DataFrame, at: str, on: list[str], bucket_days: float) -> DataFrame:
    """Points with the rows valid at them: point columns as they are, period columns as p_*."""
    width = int(bucket_days * 86_400 * US)
    rows = periods.filter(~is_empty("lo", "hi"))
    p = rows.select(*[F.col(c).alias(f"p_{c}") for c in rows.columns])
    keys = [F.col(c) == F.col(f"p_{c}") for c in on]
    inside = (F.col("p_lo") <= F.col(at)) & ends_after("p_hi", at)
    closed = p.filter("p_hi IS NOT NULL").withColumn("__b", F.explode(F.sequence(F.floor(micros(F.col("p_lo")) / width), F.floor((micros(F.col("p_hi")) - 1) / width))))
    some = points.withColumn("__a", F.floor(micros(F.col(at)) / width)).join(closed, [F.col("__a") == F.col("__b"), *keys, inside]).drop("__a", "__b")
    still = points.join(p.filter("p_hi IS NULL"), [*keys, inside])
    return some.unionByName(still)


def asof_join(left: DataFrame, right: DataFrame, at: str, right_at: str, on: str, right_on: str, take: list[str], bucket_days: float = 30) -> DataFrame:
    """Each left row with the columns `take` of the latest right row of its key at or before its time.

    Both sides are one sorted stream per key and bucket, the last right row carried forward; a bucket's
    last one goes on to the buckets after it. Of right rows with equal times the one with the largest `take` counts.
    A left row without a key or a time has no match.
    """
    carried = F.struct(*take)
    one = left.select(F.col(on).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__s"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("__r"))
    two = right.select(F.col(right_on).alias("__k"), F.col(right_at).alias("__t"), F.lit(0).alias("__s"), F.lit(None).cast(one.schema["__l"].dataType).alias("__l"), carried.alias("__r"))
    two = two.filter("__k IS NOT NULL AND __t IS NOT NULL")
    rows = _bucketed(one.filter("__k IS NOT NULL AND __t IS NOT NULL").unionByName(two), ["__k"], "__t", bucket_days)
    w = _along(["__t", "__s", "__r"]).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.last("__r", ignorenulls=True).over(w))
    rows = _carried(rows, {"__before": (F.max(F.when(F.col("__s") == 0, F.struct("__t", "__r"))), F.max)})
    found = rows.filter("__s = 1").select("__l", F.coalesce("__here", "__before.__r").alias("__r"))
    none = one.filter("__k IS NULL OR __t IS NULL").select("__l", "__r")
    return found.unionByName(none).select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in take])


def coalesce_periods(df: DataFrame, by: list[str], bucket_days: float = 30) -> DataFrame:
    """Union of periods per key (range_agg): maximal runs of overlapping or adjacent ones."""
    far = F.lit(FAR).cast("timestamp_ntz")
    rows = _bucketed(df.filter(~is_empty("lo", "hi")).select(*by, "lo", F.coalesce("hi", far).alias("hi")), by, "lo", bucket_days)
    w = _along(["lo", "hi"])
    rows = rows.withColumn("__here", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = _carried(rows, {"__reach": (F.max("hi"), F.max)})
    reach = F.greatest("__here", "__reach")
    rows = rows.withColumn("__new", F.when(reach.isNull() | (F.col("lo") > reach), F.col("lo")))
    rows = rows.withColumn("__own", F.max("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _carried(rows, {"__from": (F.max("__new"), F.max)})
    out = rows.groupBy(*by, F.coalesce("__own", "__from").alias("__start")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return out.select(*by, "lo", F.when(F.col("hi") != far, F.col("hi")).alias("hi"))


def intersect_periods(df: DataFrame, by: list[str]) -> DataFrame:
    """range_intersect_agg: the part that all periods of a key share; keys without one have none."""
    agg = df.groupBy(*by).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    return agg.filter(F.col("hi").isNull() | (F.col("lo") < F.col("hi")))


def subtract_periods(df: DataFrame, cut: DataFrame, by: list[str], bucket_days: float = 30) -> DataFrame:
    """What is left of each key's periods without those of cut (multirange minus), coalesced."""
    far = F.lit(FAR).cast("timestamp_ntz")
    plus = coalesce_periods(df, by, bucket_days).select(*by, "lo", F.coalesce("hi", far).alias("hi"), F.lit(1).alias("keep"), F.lit(0).alias("cut"))
    minus = coalesce_periods(cut, by, bucket_days).select(*by, "lo", F.coalesce("hi", far).alias("hi"), F.lit(0).alias("keep"), F.lit(1).alias("cut"))
    both = plus.unionByName(minus)
    edges = both.select(*by, F.col("lo").alias("t"), "keep", "cut").unionByName(both.select(*by, F.col("hi").alias("t"), (-F.col("keep")).alias("keep"), (-F.col("cut")).alias("cut")))
    edges = _bucketed(edges.groupBy(*by, "t").agg(F.sum("keep").alias("keep"), F.sum("cut").alias("cut")), by, "t", bucket_days)
    w = _along(["t"])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    states = edges.withColumns({"__next": F.lead("t").over(w), "__on": F.sum("keep").over(run), "__off": F.sum("cut").over(run)})
    states = _carried(states, {"__on0": (F.sum("keep"), F.sum), "__off0": (F.sum("cut"), F.sum)})
    states = _carried(states, {"__later": (F.min("t"), F.min)}, forward=False)
    on, off = (F.col(x) + F.coalesce(f"{x}0", F.lit(0)) for x in ("__on", "__off"))
    left = states.filter((on > 0) & (off == 0)).select(*by, F.col("t").alias("lo"), F.coalesce("__next", "__later").alias("hi"))
    return coalesce_periods(left.select(*by, "lo", F.when(F.col("hi") != far, F.col("hi")).alias("hi")), by, bucket_days)


def timeline(df: DataFrame, by: list[str], bucket_days: float = 30) -> DataFrame:
    """(by, t, active): how many periods are valid from each time at which the number can change."""
    rows = df.filter(~is_empty("lo", "hi"))
    edges = rows.select(*by, F.col("lo").alias("t"), F.lit(1).alias("d")).unionByName(rows.filter("hi IS NOT NULL").select(*by, F.col("hi").alias("t"), F.lit(-1).alias("d")))
    edges = _bucketed(edges.groupBy(*by, "t").agg(F.sum("d").alias("d")), by, "t", bucket_days)
    edges = edges.withColumn("__here", F.sum("d").over(_along(["t"]).rowsBetween(Window.unboundedPreceding, 0)))
    edges = _carried(edges, {"__before": (F.sum("d"), F.sum)})
    return edges.select(*by, "t", (F.col("__here") + F.coalesce("__before", F.lit(0))).alias("active"))


def snapshot(df: DataFrame, t: Column) -> DataFrame:
    return df.filter((F.col("lo") <= t) & ends_after("hi", t))


def overlap_violations(df: DataFrame, by: list[str], row: str, bucket_days: float = 30) -> DataFrame:
    """Rows that overlap an earlier one of their key: what an exclusion constraint would refuse."""
    reach = F.coalesce("hi", F.lit(FAR).cast("timestamp_ntz"))
    rows = _bucketed(df.filter(~is_empty("lo", "hi")), by, "lo", bucket_days)
    rows = rows.withColumn("__here", F.max(reach).over(_along(["lo", row]).rowsBetween(Window.unboundedPreceding, -1)))
    rows = _carried(rows, {"__before": (F.max(reach), F.max)})
    return rows.filter(F.greatest("__here", "__before") > F.col("lo")).select(*df.columns)


def close_current(df: DataFrame, which: Column, at: Column) -> DataFrame:
    """UPDATE that ends current rows: copy on write."""
    return df.withColumn("hi", F.when(which & F.col("hi").isNull(), at).otherwise(F.col("hi")))


def delete_history(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """DELETE of closed rows that overlap [a, b): copy on write."""
    gone = F.col("hi").isNotNull() & range_overlaps("lo", "hi", a, b)
    return df.filter(~F.coalesce(gone, F.lit(False)))


def bounding_boxes(df: DataFrame, by: list[str]) -> DataFrame:
    """Union of boxes per group; one open side opens the union."""
    return df.groupBy(*by).agg(
        F.min("attr").alias("attr_lo"),
        F.max("attr").alias("attr_hi"),
        F.min("lo").alias("t_lo"),
        F.when(F.max(F.col("hi").isNull()), F.lit(None)).otherwise(F.max("hi")).alias("t_hi"),
        F.when(~F.max(F.col("hi").isNull()), "HISTORY").when(F.min(F.col("hi").isNull()), "CURRENT").otherwise("MIXED").alias("kind"),
    )
