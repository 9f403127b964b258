"""Every query with SQL gives the rows that DuckDB gives, on sf0.001."""

import os

import duckdb
import pytest

from tidemill import catalog

SLOW = {"stream_features", "stream_late", "stream_dedup", "stream_invalid"}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["customer_id", "total_amount_30d", "tx_count_30d", "window_start_ms", "window_end_ms"]


def test_scan_is_pruned(spark, small):
    plan = catalog.QUERIES["materialize_range"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_do_work_once(spark, small):
    """One scan, and one parse of a payload; last windows without dealing tiles to windows."""
    run = lambda name: plan(catalog.QUERIES[name](spark, small))
    assert run("validate_valid").count("parseJson") == 1 and run("validate_invalid").count("parseJson") == 1
    for name, exchanges in (("view_aggregates", 2), ("customer_30d", 2), ("customer_30d_tiled", 2), ("online_latest", 2), ("materialize_range", 2)):
        text = run(name)
        assert text.count("FileScan") == 1 and text.count("Exchange hash") <= exchanges, name
    for name in ("online_latest", "materialize_range"):
        assert "explode" not in run(name)
