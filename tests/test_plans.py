"""Physical-plan checks: no cartesian products, no single-task windows over
data, pruning and pushdown reach the parquet scan."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SKIP = {"train_models", "cv_tuning", "feature_importance", "model_scoring", "random_search", "svm_probability"}
# queries whose core is a distributed prefix sum / rank: no stage may funnel all rows into one task
PREFIX = ["roc_auc", "roc_curve", "average_precision", "ks_drift", "exact_quantiles", "stratified_split",
          "fold_assignment", "rolling_latency", "model_metrics"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(E.queries()) if n not in SKIP and not n.startswith("stream_")])
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDF


@pytest.mark.parametrize("name", PREFIX)
def test_prefix_sums_never_use_a_single_partition(spark, name):
    assert "SinglePartition" not in _plan(spark, name)


def test_scan_is_pruned_and_filter_pushed(spark):
    plan = _plan(spark, "latency_alerts")
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,300.0)]" in plan
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in scan


def test_top_n_per_group_uses_group_limit(spark):
    assert "WindowGroupLimit" in _plan(spark, "recent_runs")
