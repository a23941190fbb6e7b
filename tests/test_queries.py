"""The registered queries against DuckDB, and laws of the algebra on the test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from quillon.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    found = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    listed = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    assert found == sorted((tuple(map(plain, r)) for r in listed), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


@pytest.fixture()
def tables(spark):
    return catalogue.session(spark, SF)


def same(a, b):
    names = sorted(a.df.columns)
    assert names == sorted(b.df.columns)
    left, right = (r.as_set().df.select(*names) for r in (a, b))
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.mark.parametrize(
    ("left", "right"),
    [
        ("customer @ c_custkey o_custkey *. orders", "customer @ c_custkey o_custkey *: n: orders <: n"),
        ("orders ?! o_totalprice > 100000", "orders -. (orders ? o_totalprice > 100000)"),
        (
            "orders # o_custkey &. (customer # c_custkey @ c_custkey o_custkey)",
            "orders # o_custkey -. (orders # o_custkey -. (customer # c_custkey @ c_custkey o_custkey))",
        ),
        (
            "orders # [o_orderkey o_orderstatus] /. o_orderstatus [n: #.]",
            "orders # [o_orderkey o_orderstatus] /: g: o_orderstatus +: n: #. g # [o_orderstatus n]",
        ),
        ("nation /: g: n_regionkey <: g", "nation"),
    ],
)
def test_laws(tables, left, right):
    assert same(tables.run(left), tables.run(right))


@pytest.mark.parametrize("name", ["q_rank", "q_bucket", "q_nest_join_count", "q_left_join_default", "q_modify_dedupe"])
def test_results_are_sets(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", ["q_rank", "q_bucket", "q_broadcast_above_avg", "q_in_member"])
def test_no_stage_gathers_all_rows(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in plan.split("\n") if "Exchange SinglePartition" in x]
    assert all("plan_id" in x for x in rows)
    assert "CartesianProduct" not in plan


def test_literals_are_broadcast_not_their_partners(spark, tables):
    """Five priorities: joined by sorting, a fifth of all orders is one task's."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        literal = '{o_orderpriority weight; "1-URGENT" 5; "2-HIGH" 3}'
        for join in (f"{literal} *. orders", f"orders *. ({literal})", f"orders *< ({literal}) [weight: 0]"):
            df = tables.run(join).df
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "LocalTableScan" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
