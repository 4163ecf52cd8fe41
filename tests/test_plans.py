"""Plan shape checks: no cartesian products, one scan per feature block,
pruned columns, partial aggregation before every shuffle of a log."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SLOW = {"train_score_gbt", "submission", "feature_importance"}


def _plan(df):
    """AQE's final plan after running the DataFrame's own physical plan."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(set(E.REGISTRY) - SLOW))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_feature_block_is_one_scan_with_expand(spark):
    plan = _plan(E.queries()["voice_features_b"](spark, SF))
    assert plan.count("lineitem.parquet") == 1
    assert "Expand" in plan
    # the log columns the block does not use are never read
    scan = [line for line in plan.splitlines() if "lineitem.parquet" in line][0]
    assert "l_extendedprice" not in scan and "l_discount" not in scan


@pytest.mark.parametrize("name", ["voice_features_a", "voice_features_b", "app_features", "sms_features_a"])
def test_shuffles_are_pre_aggregated_or_by_rank(spark, name):
    """Every hash shuffle either follows a map-side aggregation or is keyed
    by (phone, rank) / (task, group) of the distributed rank path, so no
    shuffle is keyed by the phone alone over raw rows."""
    plan = _plan(E.queries()[name](spark, SF))
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = "\n".join(lines[i + 1:i + 3])
            by_rank = any(f"{c}#" in line for c in ("_lo", "_hi", "_pid", "_blk"))
            assert by_rank or "HashAggregate" in below or "ObjectHashAggregate" in below, line
