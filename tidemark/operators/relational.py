"""Relational operators that Spark SQL has no syntax for, as DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import _carried


def distinct_on(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def with_ties(df: DataFrame, n: int, order: list[Column], by: list[str]) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES per key."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.rank().over(w)).filter(F.col("__r") <= n).drop("__r")


def top_with_ties(df: DataFrame, n: int, order: list[tuple[Column, str]]) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES overall; order is of (expression, "asc", "desc", or these with "_nulls_first" or "_nulls_last").

    The nth row is found by a bounded top-n and its peers by a null-safe semi-join on the ordering values.
    """
    values = F.struct(*[x.alias(f"o{i}") for i, (x, _) in enumerate(order)])
    top = df.orderBy(*[getattr(x, way)() for x, way in order]).limit(n).select(values.alias("__top")).distinct()
    return df.withColumn("__own", values).join(top, F.col("__own").eqNullSafe(F.col("__top")), "left_semi").drop("__own")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """NOT IN with its null rules: one null among the others and nothing qualifies."""
    keys = other.select(F.col(other_column).alias("__o"))
    has_null = keys.filter("__o IS NULL").limit(1).select(F.lit(True).alias("__n"))
    none = keys.limit(1).select(F.lit(True).alias("__any"))
    kept = df.join(keys, F.col(column) == F.col("__o"), "left_anti")
    kept = kept.join(F.broadcast(has_null), F.lit(True), "left_anti")
    return kept.join(F.broadcast(none), F.col(column).isNull(), "left_anti")


def nearest(df: DataFrame, others: DataFrame, key: str, value: str, other_key: str, other_value: str, other_id: str, n: int, width: float = 1.0) -> DataFrame:
    """Each row of df with the ids (as other_id) of the n others of its key nearest by the distance of values, ties to smaller ids.

    Without pairs: the others' distinct values are numbered along each key (buckets of `width`, a running count of each
    carried on), and a row meets the n on either side, n ids of each. Distances that rounding makes equal beyond those
    are settled by pairs of the rows concerned. Distances to infinities come after finite ones, then NaN, then null.
    """
    ids = Window.partitionBy("__k", "__kind", "__v").orderBy(F.asc_nulls_last("__id"))
    kind = F.when(F.col("__v").isNull(), "null").when(F.isnan("__v"), "nan").when(F.abs("__v") == float("inf"), F.when(F.col("__v") > 0, "inf").otherwise("-inf")).otherwise("finite")
    them = others.select(F.col(other_key).alias("__k"), F.col(other_value).cast("double").alias("__v"), F.col(other_id).alias("__id")).filter("__k IS NOT NULL").withColumn("__kind", kind)
    few = them.withColumn("__r", F.row_number().over(ids)).filter(F.col("__r") <= n)
    levels = few.filter("__kind = 'finite'").groupBy("__k", "__v").agg(F.collect_list("__id").alias("__ids"))
    # For values without a finite distance: of each kind the smallest ids.
    rest = few.withColumn("__r", F.row_number().over(Window.partitionBy("__k", "__kind").orderBy(F.asc_nulls_last("__id")))).filter(F.col("__r") <= n).select("__k", "__kind", "__v", "__id")
    asked = df.select(F.col(key).alias("__k"), F.col(value).cast("double").alias("__v")).filter("__k IS NOT NULL").distinct().withColumn("__kind", kind)
    # How many levels lie up to each value.
    points = levels.select("__k", "__v", F.lit(1).alias("__is")).unionByName(asked.filter("__kind = 'finite'").select("__k", "__v", F.lit(0).alias("__is"))).groupBy("__k", "__v").agg(F.max("__is").alias("__is"))
    points = points.withColumnRenamed("__k", "__key").withColumn("__b", F.floor(F.col("__v") / width))
    points = points.withColumn("__here", F.sum("__is").over(Window.partitionBy("__key", "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    points = _carried(points, {"__before": (F.sum("__is"), F.sum)}).select(F.col("__key").alias("__k"), "__v", (F.col("__here") + F.coalesce("__before", F.lit(0))).alias("__p"))
    numbered = levels.join(points, ["__k", "__v"]).select("__k", F.col("__v").alias("__w"), "__ids", F.col("__p").alias("__at"))
    steps = F.explode(F.sequence(F.lit(-n), F.lit(n + 1))).alias("__step")
    near = asked.filter("__kind = 'finite'").join(points, ["__k", "__v"]).select("__k", "__v", "__p", steps).withColumn("__at", F.col("__p") + F.col("__step"))
    near = near.join(numbered, ["__k", "__at"])
    # One level more on either side, of which only the distance is needed.
    beyond = F.col("__step").isin(-n, n + 1)
    distance = lambda w: F.abs(F.col("__v") - F.col(w))
    near = near.select("__k", "__v", F.when(beyond, distance("__w")).alias("__guard"), F.explode(F.when(beyond, F.array(F.lit(None).cast(them.schema["__id"].dataType))).otherwise(F.col("__ids"))).alias("__id"), distance("__w").alias("__d"))
    far = asked.withColumnRenamed("__kind", "__own").join(rest.withColumnRenamed("__v", "__w"), "__k").filter("__own <> 'finite' OR __kind <> 'finite'")
    found = near.unionByName(far.select("__k", "__v", F.lit(None).cast("double").alias("__guard"), "__id", distance("__w").alias("__d")))
    order = F.struct(F.col("__d").isNull().alias("none"), F.col("__d").alias("d"), F.col("__id").isNull().alias("no_id"), F.col("__id").alias("id"))
    best = found.groupBy("__k", "__v").agg(F.slice(F.array_sort(F.collect_list(F.when(F.col("__guard").isNull(), order))), 1, n).alias("__best"), F.min("__guard").alias("__guard"))
    unsure = F.coalesce(F.col("__guard") <= F.element_at("__best", -1).d, F.lit(False))
    sure = best.filter(~unsure).select("__k", "__v", "__best")
    again = best.filter(unsure).select("__k", "__v").join(few.select("__k", F.col("__v").alias("__w"), "__id"), "__k").withColumn("__d", distance("__w"))
    again = again.withColumn("__o", order).withColumn("__r", F.row_number().over(Window.partitionBy("__k", "__v").orderBy("__o"))).filter(F.col("__r") <= n)
    best = sure.unionByName(again.groupBy("__k", "__v").agg(F.array_sort(F.collect_list("__o")).alias("__best")))
    met = df.join(best, [F.col(key) == F.col("__k"), F.col(value).cast("double").eqNullSafe(F.col("__v"))])
    return met.select(*df.columns, F.explode("__best").alias("__one")).select(*df.columns, F.col("__one.id").alias(other_id), F.col("__one.d").alias("distance"))


def groups_frame_sum(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, name: str) -> DataFrame:
    """sum over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: a RANGE frame over the dense rank."""
    w = Window.partitionBy(*by).orderBy(order)
    ranked = df.withColumn("__g", F.dense_rank().over(w))
    return ranked.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy("__g").rangeBetween(-before, after))).drop("__g")


def exclude_sum(df: DataFrame, by: list[str], order: str, value: str, what: str, name: str) -> DataFrame:
    """sum over RANGE UNBOUNDED PRECEDING .. CURRENT ROW with EXCLUDE CURRENT ROW, GROUP or TIES."""
    w = Window.partitionBy(*by).orderBy(order)
    peers = Window.partitionBy(*by, order)
    out = {"CURRENT ROW": F.col(value), "GROUP": F.sum(value).over(peers), "TIES": F.sum(value).over(peers) - F.col(value)}[what]
    rest = {"CURRENT ROW": F.lit(1), "GROUP": F.count("*").over(peers), "TIES": F.count("*").over(peers) - 1}[what]
    total, n = F.sum(value).over(w), F.count("*").over(w)
    return df.withColumn(name, F.when(n > rest, total - out))


def hypothetical_rank(df: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """rank, dense_rank, percent_rank and cume_dist that `value` would have in each group."""
    less, n = F.count_if(F.col(order) < value), F.count(order)
    return df.groupBy(*by).agg(
        (less + 1).alias("rank"),
        (F.countDistinct(F.when(F.col(order) < value, F.col(order))) + 1).alias("dense_rank"),
        (less / n).alias("percent_rank"),
        ((F.count_if(F.col(order) <= value) + 1) / (n + 1)).alias("cume_dist"),
    )


Clause = tuple[Column | None, "str | dict[str, Column]"]


def merge(
    target: DataFrame,
    source: DataFrame,
    on: list[str],
    matched: list[Clause] = (),
    not_matched: list[Clause] = (),
    not_matched_by_source: list[Clause] = (),
) -> DataFrame:
    """MERGE as copy on write: (action, columns of target), a row for each of the target's and each inserted one.

    A clause is a condition (None: always) and what to do: "delete", "nothing", or new values by column; the
    first clause whose condition holds counts. Conditions and values see the sides as t.* and s.*. An insert
    takes columns it isn't given from the source's of the same name, or null. action is insert, update,
    delete (with the old values) or keep. A target row that two source rows would change raises ValueError.
    """
    t = target.select(F.struct(*target.columns).alias("t"), F.monotonically_increasing_id().alias("__row"))
    s = source.select(F.struct(*source.columns).alias("s"))
    how = "full" if not_matched else "left"
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], how)
    there = {"matched": F.col("t").isNotNull() & F.col("s").isNotNull(), "new": F.col("t").isNull(), "old": F.col("s").isNull()}
    clauses = [(there[side], c, what) for side, given in (("matched", matched), ("new", not_matched), ("old", not_matched_by_source)) for c, what in given]
    which = F.lit(-1)
    for i in range(len(clauses) - 1, -1, -1):
        side, condition, _ = clauses[i]
        holds = side if condition is None else side & F.coalesce(condition, F.lit(False))
        which = F.when(holds, i).otherwise(which)
    both = both.withColumn("__which", which)
    action, values = F.when(F.col("t").isNull(), "nothing").otherwise("keep"), {c: F.col(f"t.{c}") for c in target.columns}
    for i, (side, _, what) in enumerate(clauses):
        chosen, inserts = F.col("__which") == i, side is there["new"]
        if what == "nothing":
            continue
        action = F.when(chosen, "delete" if what == "delete" else "insert" if inserts else "update").otherwise(action)
        if what != "delete":
            for c in target.columns:
                given = what.get(c, (F.col(f"s.{c}") if c in source.columns else F.lit(None)) if inserts else None)
                if given is not None:
                    values[c] = F.when(chosen, given).otherwise(values[c])
    both = both.withColumn("__action", action).filter("__action <> 'nothing'")
    acted = F.count_if(F.col("__action").isin("update", "delete"))
    several = both.filter("__row IS NOT NULL").groupBy("__row").agg(F.count("*").alias("n"), acted.alias("acted")).filter("n > 1").agg(F.count("*").alias("rows"), F.max("acted").alias("acted")).first()
    if (several["acted"] or 0) > 1:
        raise ValueError("a row of the target would be changed a second time")
    if several["rows"]:
        # Several source rows met one row of the target: what changes it counts, else one of them.
        w = Window.partitionBy("__row").orderBy(F.col("__action") == "keep")
        both = both.withColumn("__n", F.row_number().over(w)).filter("__row IS NULL OR __n = 1")
    return both.select(F.col("__action").alias("action"), *[v.cast(target.schema[c].dataType).alias(c) for c, v in values.items()])


def after(changes: DataFrame) -> DataFrame:
    """The table that merge() leaves."""
    return changes.filter("action <> 'delete'").drop("action")


def merge_into(target: DataFrame, source: DataFrame, on: list[str], update: dict[str, Column], insert: bool = True, delete: Column | None = None) -> DataFrame:
    """The table after MERGE: matched rows are deleted or updated, others of source inserted. Conditions and values see t.* and s.*."""
    matched: list[Clause] = [(delete, "delete")] if delete is not None else []
    return after(merge(target, source, on, [*matched, (None, update or "nothing")], [(None, {})] if insert else []))


def insert_on_conflict(target: DataFrame, rows: DataFrame, on: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (on): changes as of merge(). Without `update` conflicting rows are left out.

    Rows with a null in `on` never conflict. Of new rows that conflict with each other one stays without
    `update`; with it they raise ValueError, as they would change a row a second time.
    """
    nulls = F.lit(False)
    for k in on:
        nulls = nulls | F.col(k).isNull()
    keyed = rows.filter(~nulls)
    if update is None:
        w = Window.partitionBy(*on).orderBy(*[c for c in rows.columns if c not in on] or on)
        keyed = keyed.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    elif not keyed.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("a row of the target would be changed a second time")
    changes = merge(target, keyed, on, [(None, update or "nothing")], [(None, {})])
    free = [F.lit("insert").alias("action"), *[F.col(c) if c in rows.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns]]
    return changes.unionByName(rows.filter(nulls).select(*free))


def update_from(target: DataFrame, source: DataFrame, on: list[str], update: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: changes as of merge(); one of several matching source rows counts."""
    one = source.dropDuplicates(on)
    return merge(target, one, on, [(where, update)])


def delete_using(target: DataFrame, source: DataFrame, on: list[str], where: Column | None = None) -> DataFrame:
    """DELETE ... USING: changes as of merge(); action delete is what RETURNING gives."""
    one = source.dropDuplicates(on)
    return merge(target, one, on, [(where, "delete")])


def moved(target: DataFrame, into: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """WITH gone AS (DELETE ... RETURNING *) INSERT INTO ... SELECT * FROM gone: both tables afterwards."""
    hit = F.coalesce(which, F.lit(False))
    return target.filter(~hit), into.unionByName(target.filter(hit).select(*into.columns))


def recursive_distinct(seed: DataFrame, step, max_rounds: int | None = None) -> DataFrame:
    """WITH RECURSIVE ... UNION (distinct): only rows not seen before feed the next round, until none is new.

    step(frontier) gives the rows that follow; rounds are checkpointed where a folder is set. A limit on
    rounds is off by default and raises when it is reached.
    """
    spark = seed.sparkSession
    keep = (lambda d: d.checkpoint()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda d: d.persist())
    found = frontier = keep(seed.distinct())
    done = 0
    while max_rounds is None or done < max_rounds:
        done += 1
        frontier = keep(step(frontier).select(*seed.columns).distinct().exceptAll(found.select(*seed.columns)).distinct())
        if frontier.isEmpty():
            return found
        found = keep(found.unionByName(frontier))
    raise ValueError(f"no end after {max_rounds} rounds")


def connect_by(df: DataFrame, key: str, parent: str, start: Column, max_depth: int | None = None, sep: str = "~") -> DataFrame:
    """(key, parent, level, branch) of the tree below `start`, down to max_depth levels or, without it, to the end.

    A row that is below itself raises ValueError; levels are checkpointed where a folder is set.
    """
    keep = (lambda d: d.checkpoint()) if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda d: d.persist())
    edges = df.select(F.col(key).alias("k"), F.col(parent).alias("p")).filter("p IS NOT NULL")
    level = df.filter(start).select(F.col(key).alias(key), F.lit(None).cast(df.schema[parent].dataType).alias(parent), F.lit(0).alias("level"), F.col(key).cast("string").alias("branch"), F.array(key).alias("__path"))
    out, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        below = level.join(edges, F.col(key) == F.col("p"))
        level = keep(below.select(F.col("k").alias(key), F.col("p").alias(parent), (F.col("level") + 1).alias("level"), F.concat_ws(sep, "branch", F.col("k").cast("string")).alias("branch"), F.concat("__path", F.array("k")).alias("__path"), F.array_contains("__path", F.col("k")).alias("__again")))
        if level.isEmpty():
            break
        if not level.filter("__again").isEmpty():
            raise ValueError(f"a cycle at level {depth}")
        level = level.drop("__again")
        out = out.unionByName(level)
    return out.drop("__path")


def crosstab(df: DataFrame, row: str, category: str, value: str, categories: list, order: str | None = None) -> DataFrame:
    """crosstab(sql, categories): one row per name, a column per category, the last value of each by `order` (without it, the largest)."""
    return df.groupBy(row).pivot(category, categories).agg(F.max_by(value, order) if order else F.max(value))


def rows_from(*arrays: Column) -> Column:
    """ROWS FROM / several set-returning functions in step, shorter ones padded with nulls."""
    return F.arrays_zip(*arrays)


def sample_rows(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """TABLESAMPLE BERNOULLI REPEATABLE."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
