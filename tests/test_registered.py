"""Registered queries against their SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from slabworks import member_queries, queries, service_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(map(str, ([r[c] for c in order] for r in df.collect())))
    theirs = sorted(map(str, ([r[names.index(c)] for c in order] for r in found.fetchall())))
    assert ours == theirs


def test_every_query_is_registered(spark):
    import __spark_entry__ as e

    assert {"folder_datasets", "http_data"} <= {*queries.QUERIES} & {*vars(service_queries)}
    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() == 50


def test_slabs_reach_the_scan(spark):
    plan = queries.QUERIES["slab_2d"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(vec_id), GreaterThanOrEqual(vec_id,10), LessThanOrEqual(vec_id,19)]" in plan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    plan = queries.QUERIES["slab_range_1d"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan
