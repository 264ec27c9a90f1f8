"""Every registered query against its SQL, and plan checks."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# queries whose large-input path is run as well
BLOCKED = ["a1_wait_summary", "a3_ks", "a4_spearman", "a6_compare_table", "j3_asof_step", "j6_covering_sum", "j11_earliest_fit",
           "j12_cap_audit_running", "p7_queue_snapshot_full", "r1_bootstrap", "t5_availability", "t8_free_profile_pools"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", BLOCKED)
def test_block_path_equals_sql(spark, con, name):
    spark.conf.set("nodehours.blockRows", "200")
    try:
        assert compare(entry.queries()[name](spark, SF), con, SQL[name]) is None
    finally:
        spark.conf.unset("nodehours.blockRows")


def test_timeline_reads_only_its_columns(spark):
    plan = entry.queries()["t3_busy_timeline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double,props:string>" in plan


def test_capped_snapshot_limits_before_the_shuffle(spark):
    plan = entry.queries()["p7_queue_snapshot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fit_ranking_orders_no_pairs_for_a_correlation_it_drops(spark, monkeypatch):
    from nodehours.operators import stats
    monkeypatch.setattr(stats, "spearman", lambda *a: pytest.fail("not read by the ranking"))
    assert entry.queries()["a7_fit_ranking"](spark, SF).count() == 3
