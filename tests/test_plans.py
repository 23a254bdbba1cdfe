"""The ready-made queries give the rows of their SQL, and their plans are as meant."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def ordered(df):
    columns = sorted(df.columns)
    df = df[columns].astype({c: "float64" for c in columns if df[c].dtype.kind in "if"})
    return df.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_of_the_sql(spark, duck, name):
    a, b = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        near = (a[c] - b[c]).abs() <= 1e-9 * b[c].abs() if a[c].dtype.kind == "f" else False
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna()) | near).all(), c


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["flagship"](spark, SF))
    assert "GreaterThan(l_quantity,10.0)" in plan and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in plan
    assert "partial_sum" in plan and "__order" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan_of(QUERIES["select_fields"](spark, SF))


def test_top_rows_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["join_inner"](spark, SF).orderBy("o_orderkey").limit(3))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_full_outer_join_has_keys_of_one_side_only(spark):
    found = QUERIES["join_full_outer_by_balance"](spark, SF).toPandas()
    assert found.c_name.isna().any() and found.orders.isna().any() and (found.c_name.notna() & found.orders.notna()).any()
