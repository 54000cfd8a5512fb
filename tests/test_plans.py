"""Physical plans: what reaches the scan, what is moved, and what must not appear."""

import pytest

from __spark_entry__ import entry, queries
from movewell.plans.oracles import ORACLES
from movewell.plans.queries import REGISTRY
from movewell.schemas import GOLD

STARTS_JOBS = {"bronze_stream", "gold_stream", "gold_stream_rebuild", "gold_stream_sql", "gold_stream_rules", "notifications_stream",
               "gold_sql_kpi", "gold_sql_total", "hr_writeback", "activity_load", "dq_table", "stream_progress", "gold_trailing_stream", "wellness_daily",
               "unreadable_messages", "stream_heartbeats", "batch_rate_stream", "counter_increase_stream", "notifications_topic", "gold_current_stream",
               "dq_loads", "notifications_folded", "bronze_folded"}
LAZY = sorted(set(REGISTRY) - STARTS_JOBS)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, tables, name):
    plan = plan_of(queries()[name](spark, tables))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "ArrowEval"):
        assert operator not in plan


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_without_broadcast(spark, tables, no_broadcast, name):
    plan = plan_of(queries()[name](spark, tables))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_queries_that_start_jobs_have_no_cross_join(spark, tables):
    plan = plan_of(queries()["hr_writeback"](spark, tables))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_count_reads_only_what_it_needs(spark, tables):
    plan = plan_of(queries()["wellness_days"](spark, tables))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "partial_count" in plan


def test_trailing_period_reaches_the_scan(spark, tables):
    plan = plan_of(queries()["wellness_trailing"](spark, tables))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(o_orderdate" in plan


def test_decoding_moves_nothing(spark, tables):
    assert "Exchange" not in plan_of(queries()["cdc_decode"](spark, tables))


def test_literal_rules_share_one_scan(spark, tables):
    plan = plan_of(queries()["dq_statistics"](spark, tables))
    assert plan.count("orders.parquet") == 2  # the literal rules, and the ids


def test_every_query_has_a_twin():
    assert set(REGISTRY) == set(ORACLES) <= set(queries())


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == GOLD.names and frame.count() == 150
