"""Every registered query against its SQL at the smallest scale, and plan checks."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = Path(entry.ENTRY_DIR)
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [
        tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order)
        for r in rows
    ]
    return sorted(names), sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry.library_queries()))
def test_query_equals_sql(spark, sql, name):
    df = entry.library_queries()[name](spark, str(DATA))
    found = sql.execute(entry.library_sql()[name])
    want = comparable([c[0] for c in found.description], found.fetchall())
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_query_has_sql():
    assert set(entry.library_queries()) == set(entry.library_sql())


def test_known_answer(spark):
    assert [tuple(r) for r in entry.entry(spark).collect()] == [
        (44, 2.936118), (103, 2.725035), (160, 2.603887), (134, 2.5006), (198, 2.476794)
    ]


@pytest.mark.parametrize("name", sorted(entry.library_queries()))
def test_plans_have_no_cross_join_and_no_row_python(spark, name):
    plan = entry.library_queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan


def plan_of(spark, name):
    return entry.library_queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "user_history")
    assert "EqualTo(o_custkey,13)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_limits_are_pushed_below_the_shuffle(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "top_users")
    assert plan_of(spark, "item_knn").count("WindowGroupLimit") == 2
    assert plan_of(spark, "recommend_all").count("WindowGroupLimit") == 4


def test_payloads_are_parsed_once(spark):
    assert plan_of(spark, "decode_drop_bad").count("from_json") == 1


def test_first_record_of_conversations_that_start_late(spark, tmp_path):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 2500, "u", "c"), (2, 1200, "u", "d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = entry.first_record(spark, str(tmp_path))
    assert sorted((r.conv_id, r.turn, r.text) for r in out.collect()) == [(1, 0, "a"), (2, 1200, "d")]
