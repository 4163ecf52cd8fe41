"""Feature blocks of logs dealt by phone, of hot phones spread by value, and
of both in one log: the same rows as by groups alone; dealt rows move once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from phonelens.functions import grain
from phonelens.operators import app as A
from phonelens.operators import sms as SM
from phonelens.operators import voice as V
from phonelens.plans.queries import stable
from tests.fixtures import VOICE_SCHEMA

START = datetime(2020, 1, 1)


def _voice(spark):
    """Phone 0 has half of the rows; NULLs in every column."""
    def row(i):
        some = lambda x, n: None if i % n == 0 else x
        phone = None if i % 97 == 0 else "p0" if i % 2 else f"p{i % 23}"
        return (phone, some(f"c{i * 7 % 31}", 11), some(1 + i % 3, 13), some(START + timedelta(hours=5 * i), 17),
                some(float(i * 3 % 40), 5), some(f"t{i % 4}", 7), some(f"k{i % 9}", 19), some(f"h{i * 5 % 13}", 23))
    return spark.createDataFrame([row(i) for i in range(600)], VOICE_SCHEMA)


def _app(spark):
    v = _voice(spark)
    return v.select("phone_no_m", F.col("county_name").alias("busi_name"), F.col("call_dur").alias("flow"),
                    F.date_format("start_datetime", "yyyy-MM").alias("month_id"))


BLOCKS = {"a": (V.voice_features_a, _voice), "b": (V.voice_features_b, _voice), "classes": (V.voice_class_measures, _voice),
          "app": (A.app_features, _app),
          "sms": (lambda v: SM.sms_features_a(v.withColumnRenamed("start_datetime", "request_datetime")), _voice)}


@pytest.mark.parametrize("hot_rows", [100, 10_000])
@pytest.mark.parametrize("block", sorted(BLOCKS))
def test_dealt_rows_give_the_same_block(spark, monkeypatch, block, hot_rows):
    fn, log = BLOCKS[block]
    log = log(spark).localCheckpoint()
    want = sorted(map(tuple, stable(fn(log)).collect()), key=str)
    monkeypatch.setattr(grain, "SMALL_LOG", 0)
    monkeypatch.setattr(grain, "HOT_ROWS", hot_rows)
    got = stable(fn(log))
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == 23


@pytest.mark.parametrize("block", ["a", "b", "app"])
def test_dealt_rows_move_once(spark, monkeypatch, block):
    fn, log = BLOCKS[block]
    monkeypatch.setattr(grain, "SMALL_LOG", 0)
    out = fn(log(spark))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Expand" not in plan


def test_hot_phone_is_not_dealt(spark, monkeypatch):
    monkeypatch.setattr(grain, "SMALL_LOG", 0)
    monkeypatch.setattr(grain, "HOT_ROWS", 100)
    log = _voice(spark).filter("phone_no_m is not null")
    dealt, spread = grain.deal_by_key(log, "phone_no_m")
    assert [r[0] for r in spread.select("phone_no_m").distinct().collect()] == ["p0"]
    assert dealt.filter("phone_no_m = 'p0'").count() == 0 and dealt.count() + spread.count() == log.count()
