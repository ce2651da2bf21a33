"""Every registered query of the base library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (float, np.floating)) or type(value).__name__ == "Decimal":
        return f"{float(value):.9g}"
    return str(int(value)) if isinstance(value, np.integer) else str(value)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.astype(object).to_numpy().tolist()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, oracle, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), oracle.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_numerals_of_large_keys(spark, tmp_path):
    """Sizes beyond the SQL's last unit."""
    at = f"{tmp_path}/part.parquet"
    duckdb.connect().execute(f"COPY (SELECT k::BIGINT AS p_partkey, 'x' AS p_name, 1 + (k % 50)::INT AS p_size, 900.5 + k % 7 AS p_retailprice FROM (SELECT unnest([0, 10, 11, 10737, 10738, 10739, 1200000, 20000000]) AS k)) TO '{at}'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{at}')")
    assert rows(QUERIES["v_numerals"](spark, str(tmp_path)).toPandas()) == rows(con.execute(SQL["v_numerals"]).df())


def test_nearest_per_key_of_odd_values(spark, tmp_path):
    """Equal values and ids, values that differ by less than rounding, nulls, infinities, few of a key; no pairs are joined."""
    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT * FROM (VALUES (0.0), (5.5), (5.5), (1e-18), (2e-18), (3e-18), (4e-18), (5e-18), (6e-18), (100.0), (-3.25), ('inf'), ('-inf'), ('nan'), (NULL), (NULL), (7.0), (1e308), (-1e308)) t(b)")
    con.execute("CREATE TABLE customer AS SELECT (row_number() OVER () * 7919 % 1009)::BIGINT AS c_custkey, (i % 3)::INT AS c_nationkey, b::DOUBLE AS c_acctbal FROM v, range(4) t(i)")
    con.execute("INSERT INTO customer VALUES (1, 7, 3.0), (2, 7, NULL), (5, NULL, 1.0)")
    con.execute("CREATE TABLE supplier AS SELECT row_number() OVER () AS s_suppkey, k::INT AS s_nationkey, b::DOUBLE AS s_acctbal FROM v, (VALUES (0), (1), (7), (9), (NULL)) t(k)")
    for name in ("customer", "supplier"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    df = QUERIES["j_knn_per_key"](spark, str(tmp_path))
    assert rows(df.toPandas()) == rows(con.execute(SQL["j_knn_per_key"]).df())
    assert "(s_nationkey#" not in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "c_nationkey" in x and "Join" in x)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
