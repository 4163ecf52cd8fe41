
import math

from pyspark.sql import functions as F

from phonelens.functions.expr import np_round
from phonelens.operators import app as A
from phonelens.operators import sms as SM
from phonelens.operators import user as U
from phonelens.operators import voice as V
from tests import fixtures as fx
from tests.conftest import by_key


def test_null_key_dropped(spark):
    out = by_key(V.voice_features_b(fx.null_key_voice(spark)))
    assert set(out) == {"a"}


def test_one_row_variance_null_median_value(spark):
    f = by_key(V.voice_features_a(fx.one_row_voice(spark)))["a"]
    assert f["call_dur_median"] == 7.0
    assert f["phone2opposite_median"] == 1.0
    spread = by_key(V.voice_duration_spread(fx.one_row_voice(spark)))["a"]
    assert spread["dure_std"] is None


def test_mode_tie_takes_smallest(spark):
    f = by_key(SM.sms_features_a(fx.mode_tie_sms(spark)))["a"]
    assert (f["hour_mode"], f["hour_mode_count"], f["hour_nunique"]) == (1, 2, 2)


def test_all_null_sum_is_zero_mean_null(spark):
    f = by_key(V.voice_features_b(fx.all_null_dur_voice(spark)))["a"]
    assert f["dure_sum"] == 0.0
    assert f["call_dur_mean"] is None


def test_no_caller_columns_null(spark):
    fa = by_key(V.voice_features_a(fx.no_caller_voice(spark)))["a"]
    for c in ("voccalltype1", "imeis", "voc_calltype1", "city_name_call", "county_name_call"):
        assert fa[c] is None, c
    fb = by_key(V.voice_features_b(fx.no_caller_voice(spark)))["a"]
    assert fb["call_diff_01"] is None and fb["call_diff_02"] == 2
    assert fb["averge_call_01"] is None and fb["ratio"] is None


def test_no_short_call_ratio_null(spark):
    f = by_key(V.voice_features_b(fx.no_short_voice(spark)))
    assert f["a"]["ratio"] is None
    assert f["b"]["ratio"] == 0.5
    r = by_key(V.short_call_ratio(fx.no_short_voice(spark)))
    assert r["a"]["tmp1"] is None and r["a"]["tmp2"] == 2


def test_arpu_gap_gives_null_mean(spark):
    df = spark.createDataFrame([("a", 1.0, None, 3.0), ("b", 1.0, 2.0, 3.0)], "phone_no_m string, m1 double, m2 double, m3 double")
    out = by_key(U.user_arpu_mean(df, ["m1", "m2", "m3"]))
    assert out["a"]["arpu_"] is None and out["b"]["arpu_"] == 2.0
    assert "m1" not in out["a"]
    skip = by_key(U.user_arpu_mean(df, ["m1", "m2", "m3"], skip_nulls=True))
    assert skip["a"]["arpu_"] == 2.0


def test_numpy_round_half_even(spark):
    df = spark.createDataFrame([(0.12345,), (1.00005,), (0.00025,)], "x double")
    got = [r[0] for r in df.select(np_round(F.col("x"), 4)).collect()]
    import numpy as np
    assert got == [float(np.round(x, 4)) for x in (0.12345, 1.00005, 0.00025)]
    assert got[:2] == [0.1234, 1.0001]


def test_app_flow_month_and_var(spark):
    df = fx.app(spark, [("a", "w", 10.0, "2020-01"), ("a", "w", 30.0, "2020-02"), ("a", "q", 20.0, "2020-02"),
                        ("b", "w", 5.0, "2020-01")])
    out = by_key(A.app_features(df))
    assert out["a"]["busi_count"] == 2 and out["a"]["month_ids"] == 2
    assert out["a"]["flow_month"] == 30.0 and out["a"]["flow_median"] == 20.0
    assert math.isclose(out["a"]["flow_var"], 100.0)
    assert out["b"]["flow_var"] is None


def test_sms_type2_null_when_absent(spark):
    df = fx.sms(spark, [("a", "x", 1, fx.ts(1)), ("b", "x", 2, fx.ts(1)), ("b", "y", 1, fx.ts(1))])
    out = by_key(SM.sms_features_a(df))
    assert out["a"]["calltype_2"] is None and out["a"]["calltype_rate"] is None
    assert out["b"]["calltype_2"] == 1 and out["b"]["calltype_rate"] == 0.5
    b = by_key(SM.sms_features_b(df))
    assert b["b"]["calltype_id_sum"] == 1 and b["a"]["calltype_id_sum"] == 0


def test_parse_datetime_and_month(spark):
    from phonelens.functions.expr import month_of, parse_datetime
    df = spark.createDataFrame([("2020-03-04 05:06:07",), ("junk",)], "t string")
    got = df.select(parse_datetime("t").alias("ts")).select("ts", month_of("ts").alias("m")).collect()
    assert got[0]["ts"].hour == 5 and got[0]["m"] == 3
    assert got[1]["ts"] is None
