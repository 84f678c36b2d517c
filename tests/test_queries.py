"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from conftest import DATA
from popmeasure.plans import comparisons, measures, preferences  # noqa: F401
from popmeasure.plans.registry import ORACLES, PLANS


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool) or isinstance(v, (str, datetime.date)):
        return str(v)
    return f"{float(v):.5f}"


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted("|".join(text(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = PLANS[name](spark, DATA)
    got = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert PLANS[name](spark, DATA).count() > 0
    spark.catalog.clearCache()


def test_no_cartesian_product_and_no_python_in_metrics(spark):
    plan = PLANS["a12_item_metrics"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = PLANS["s1_columnar_scan"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
