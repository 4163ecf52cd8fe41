"""Blocks stored in buckets: same rows, no shuffle, readable by a later session."""

import os
import tempfile

import pytest

from phonelens.plans import dataset as D
from phonelens.sources import sinks, views

SF = "/root/testdata/sf0.001"


def _final_plan(df):
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString().split("== Initial Plan ==")[0]


def _rows(df):
    return sorted((str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()))


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _inputs(spark):
    # users lack every seventh phone, so that the full join has both sides open
    users = views.users(spark, SF).filter("phone_no_m % 7 <> 0")
    return users, views.voice(spark, SF), views.sms(spark, SF), views.app(spark, SF), views.ARPU_COLS


def test_stored_blocks_join_without_a_shuffle(spark, no_broadcast):
    folder = tempfile.mkdtemp(prefix="phonelens-bucket-", dir="/tmp")
    stored = D.store_blocks(D.outer_blocks(*_inputs(spark)), folder, "bk_test", 4)
    joined = D.join_stored_blocks(stored)
    plan = _final_plan(joined)
    assert plan.count("SortMergeJoin") == 4 and "Exchange" not in plan
    want = D.outer_dataset(*_inputs(spark))
    assert sorted(joined.columns) == sorted(want.columns)
    assert _rows(joined) == _rows(want)

    # a session whose catalog does not know the tables
    for name in stored:
        spark.sql(f"DROP TABLE bk_test_{name}")
    again = D.join_stored_blocks(D.open_blocks(spark, folder, "bk_test", ["users", "voice", "sms", "app"], 4))
    assert "Exchange" not in _final_plan(again)
    assert _rows(again) == _rows(want)


def test_grouping_a_bucketed_table_needs_no_shuffle(spark):
    folder = tempfile.mkdtemp(prefix="phonelens-bucket-", dir="/tmp")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "phone_no_m string, n int")
    t = sinks.write_bucketed(df, "bk_group", os.path.join(folder, "t"), 4)
    g = t.groupBy("phone_no_m").sum("n")
    assert "Exchange" not in _final_plan(g)
    assert {tuple(r) for r in g.collect()} == {("a", 3), ("b", 3), (None, 4)}
    # a second write replaces the first
    t = sinks.write_bucketed(df.filter("n > 2"), "bk_group", os.path.join(folder, "t"), 4)
    assert t.count() == 2


def test_users_with_repeated_and_null_phones_stay(spark):
    folder = tempfile.mkdtemp(prefix="phonelens-bucket-", dir="/tmp")
    users = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("z", 4)], "phone_no_m string, u int")
    block = lambda rows, c: spark.createDataFrame(rows, f"phone_no_m string, {c} int")
    blocks = {"users": users, "x": block([("a", 7), ("b", 8)], "x"), "y": block([("b", 9), ("c", 10)], "y")}
    got = D.join_stored_blocks(D.store_blocks(blocks, folder, "bk_null", 4))
    want = users.join(blocks["x"], "phone_no_m", "full").join(blocks["y"], "phone_no_m", "full")
    assert _rows(got) == _rows(want)
