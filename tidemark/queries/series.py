"""Generated tables, sources and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import generator, layouts
from .registry import Registry, read

REGISTRY = Registry()
frame, pair = REGISTRY.frame, REGISTRY.pair

ROWS = 20_000


def between(u: str, least: int, most: int) -> str:
    return f"(floor({u} * {most - least + 1}) + {least})::INT"


def preset_sql(name: str, rows: int, seed: int = 42) -> str:
    """The generated table, recomputed."""
    p = generator.PRESETS[name]
    u = lambda use: f"(('0x' || substr(md5('{seed}:{use}:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    position = "id - 1" if p.order == "chronological" else f"floor({u(1)} * {rows})::BIGINT"
    hours = "CASE " + " ".join(f"WHEN {u(3)} < {share} THEN {between(u(4), least, most)}" for share, least, most in generator.WIDTHS[p.width]) + " END"
    attr = between(u(5), 1, 100)
    if p.attrs == "zipf":
        attr = f"floor(pow({attr}::DOUBLE, -1.5))::INT"
        if p.hot_current:
            total = sum(1 / i for i in range(1, 11))
            hot = " ".join(f"WHEN {u(7)} * {total!r}::DOUBLE < {sum(1 / j for j in range(1, i + 1))!r}::DOUBLE THEN {i}" for i in range(1, 11))
            attr = f"CASE WHEN {u(2)} < {p.open_ratio} AND {u(6)} < {p.hot_current} THEN CASE {hot} END ELSE {attr} END"
    return f"""SELECT id, attr, lo, CASE WHEN NOT current THEN lo + to_hours(hours) END AS hi, 'payload_' || (id - 1) AS payload FROM (
        SELECT id, {attr} AS attr, TIMESTAMP '2023-01-01' + to_days((({position}) % 3650)::INT) AS lo, {u(2)} < {p.open_ratio} AS current, {hours} AS hours FROM (SELECT range AS id FROM range(1, {rows + 1})))"""


for preset in generator.PRESETS:
    frame(f"g_{preset}", lambda s, d, p=preset: generator.generate(s, ROWS, p), preset_sql(preset, ROWS))


def laid_out(s, d, layout):
    """The rows that overlap half of 1996, in closed boxes of attribute 10 or as ranges, by way of a written layout."""
    path = f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark_layout_{layout}"
    layouts.write_layout(read(s, d, "orders_valid").select("id", "attr", "lo", "hi"), path, layout)
    boxes = layout in ("gist_attr_period", "temporal_rtree")
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1996-07-01"))
    return layouts.overlapping(s, path, layout, a, b, 10 if boxes else None).select("id", "attr", "lo", "hi")


for layout in layouts.LAYOUTS:
    boxes = layout in ("gist_attr_period", "temporal_rtree")
    frame(
        f"g_layout_{layout}",
        lambda s, d, x=layout: laid_out(s, d, x),
        "SELECT id, attr, lo, hi FROM orders_valid WHERE "
        + ("attr = 10 AND lo <= '1996-07-01' AND (hi IS NULL OR hi >= '1996-01-01')" if boxes else "lo < '1996-07-01' AND (hi IS NULL OR hi > '1996-01-01') AND (hi IS NULL OR hi > lo)"),
    )
pair("g_random", "SELECT count(*) AS n, count_if(x >= 0 AND x < 1) AS inside FROM (SELECT rand(7) AS x FROM range(1000))", "SELECT 1000 AS n, 1000 AS inside")
pair("g_setseed", "SELECT count(DISTINCT x) AS same FROM (SELECT round(sum(r), 6) AS x FROM (SELECT rand(3) AS r FROM range(0, 100, 1, 1)) UNION ALL SELECT round(sum(r), 6) FROM (SELECT rand(3) AS r FROM range(0, 100, 1, 1)))", "SELECT 1 AS same")
frame("g_file_metadata", lambda s, d: read(s, d, "nation").select("n_nationkey", F.col("_metadata.file_name").alias("f")), "SELECT n_nationkey, 'nation.parquet' AS f FROM nation")
frame("g_row_address", lambda s, d: read(s, d, "nation").filter("_metadata.row_index BETWEEN 5 AND 9").select("n_nationkey"), "SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER () - 1 AS r FROM nation) z WHERE r BETWEEN 5 AND 9")
