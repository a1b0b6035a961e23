"""Every query with SQL against DuckDB at the smallest size; the others for rows and a stable schema."""

import math
import os

import duckdb
import pytest

from pricelode.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    order = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops(spark, sf, name):
    """Range, null-safe and blocked joins stay equi-joins, and totals are scalar subqueries."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["deal_features"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1]
    plan = QUERIES["family_comparison"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" in plan.split("PushedFilters")[1].split("ReadSchema")[0]
