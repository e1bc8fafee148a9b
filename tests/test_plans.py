"""Plan-shape checks: no Python in the plans, filters and column pruning reach
the Parquet scan, and the date-keyed joins never shuffle activity on the date."""

import pytest

from vitalspark.plans.analyses import ANALYSES
from vitalspark.plans.registry import run_analysis

from conftest import SF_SMALL


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {key: _physical(run_analysis(spark, SF_SMALL, key)) for key in ANALYSES}


def test_no_python_udf_and_no_cartesian_product(plans):
    for key, plan in plans.items():
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, key
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key


def test_hash_aggregation_only(plans):
    # Every aggregate is a (partial + final) hash aggregate: no sort-based
    # aggregation and no sort feeding a grouping.
    for key, plan in plans.items():
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan, key
    assert "Sort [" not in plans["weekday_avg"]


def test_event_kind_filter_and_pruning_reach_the_scan(plans):
    plan = plans["sleep_clean"]
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    # props and event_id are never read
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plans["intensity_level"]


def test_date_only_joins_are_salted(spark):
    off = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k, None) for k in off}
    for k in off:
        spark.conf.set(k, "-1")
    try:
        plans = {k: _physical(run_analysis(spark, SF_SMALL, k)) for k in ("user_segments", "sleep_on_activity_days", "segment_share")}
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for key, plan in plans.items():
        joins = [line for line in plan.splitlines() if "Join [" in line]
        assert joins and all("SortMergeJoin [Date" in j and "_salt" in j for j in joins), (key, joins)
        assert "Broadcast" not in plan, key


def test_numbering_reads_its_stored_input(plans):
    # numbering reads its checkpointed input, not the event log again
    assert "FileScan" not in plans["consecutive_ids"] and "Scan ExistingRDD" in plans["consecutive_ids"]


def test_fits_add_no_join(plans):
    # The fitted line reads the model through a scalar subquery, never a join.
    for key in ("user_totals_fit", "mets_frequency_fit"):
        assert "Join" not in plans[key], key
    assert "Join" not in plans["sleep_calories_fit"]  # both tables come from one aggregation


def test_two_tables_in_one_aggregation(spark, plans):
    # one scan, one exchange, no join, nothing stored
    for key in ("heartrate_calories", "sample_user_days", "sample_user_drilldown"):
        plan = plans[key]
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1, key
        assert "Join" not in plan and "ExistingRDD" not in plan, key
    # one more exchange by user
    assert plans["sleep_vs_calories"].count("FileScan") == 1 and "Join" not in plans["sleep_vs_calories"]


def test_sampled_ids_filter_the_scan(plans):
    assert "TakeOrderedAndProject" in plans["sample_users"]
    # keys are drawn without the measures
    assert "value" not in plans["sample_users"].split("ReadSchema")[1]
    for key in ("sample_user_days", "sample_user_fits", "sample_user_drilldown"):
        pushed = plans[key].split("PushedFilters")[1].split("ReadSchema")[0]
        assert "user_id" in pushed and ("In(user_id" in pushed or "EqualTo(user_id" in pushed), (key, pushed)
