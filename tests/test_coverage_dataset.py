"""Coverage, segments and data-set assembly on hand-made tables."""

from pyspark.sql import functions as F

from phonelens.operators import coverage as C
from phonelens.plans import dataset as DS
from tests import fixtures as fx
from tests.conftest import by_key, rows

USERS = "phone_no_m string, city_name string, county_name string, m1 double, m2 double, label int, split string"


def _users(spark):
    return spark.createDataFrame([
        ("a", "x", "k", 1.0, 2.0, 1, "train"),
        ("b", None, "k", 1.0, None, 0, "train"),
        ("c", "y", "q", 3.0, 3.0, 0, "train"),
        ("t", "x", "k", 5.0, 5.0, None, "test"),
    ], USERS)


def _voice(spark):
    # "z" is an outsider: in the log, not in the user table
    return fx.voice(spark, [("a", "b", 1, fx.ts(1), 3.0, "c", "k", "h1"),
                            ("a", "c", 1, fx.ts(2), 9.0, "c", "k", "h1"),
                            ("z", "a", 1, fx.ts(2), 9.0, "c", "k", "h2"),
                            ("t", "a", 2, fx.ts(3), 1.0, "c", "k", "h3")])


def _app(spark):
    return fx.app(spark, [("a", "w", 1.0, "2020-01"), ("a", "w", 1.0, "2020-02"), ("c", "w", 1.0, "2020-01")])


def _sms(spark):
    return fx.sms(spark, [("a", "b", 1, fx.ts(1, 4)), ("c", "a", 2, fx.ts(1, 5))])


def test_log_coverage_and_test_coverage(spark):
    u = _users(spark).filter("split = 'train'")
    cov = {r["log"]: (r["missing"], r["missing_scam"]) for r in
           C.log_coverage(u, {"voice": _voice(spark), "app": _app(spark)}).collect()}
    assert cov == {"voice": (2, 0), "app": (1, 0)}
    assert C.test_coverage(_users(spark).filter("split = 'test'"), _voice(spark)).first()["missing"] == 0


def test_low_usage_starts_from_users(spark):
    u = _users(spark).filter("split = 'train'")
    seg = {r["label"]: r.asDict() for r in C.low_usage_segment(u, _app(spark), 2).collect()}
    # b has no app row: 0 months, still in the segment
    assert seg[0] == {"label": 0, "users": 2, "app_phones": 1, "low_usage": 2}
    assert seg[1]["low_usage"] == 0
    phones = rows(C.low_usage_phones(u, _app(spark), 2), "phone_no_m")
    assert phones == [("b",), ("c",)]


def test_segment_contacts_counts_zero(spark):
    u = _users(spark).filter("split = 'train'")
    seg = C.low_usage_phones(u, _app(spark), 2)
    out = {r["label"]: r.asDict() for r in C.segment_contacts(seg, _voice(spark), u, more_than=0).collect()}
    assert out[0]["segment_phones"] == 2 and out[0]["no_contact"] == 2 and out[0]["over_bound"] == 0
    assert out[1]["log_phones"] == 1 and out[1]["segment_phones"] is None


def test_outer_dataset_keeps_outsider_unlabelled(spark):
    u = DS.with_test_unlabelled(_users(spark))
    ds = by_key(DS.outer_dataset(u, _voice(spark), _sms(spark), _app(spark), ["m1", "m2"]))
    assert ds["z"]["label"] is None and ds["z"]["split"] is None and ds["z"]["call_diff_01"] == 1
    assert ds["t"]["label"] is None and ds["a"]["arpu_"] == 1.5 and ds["b"]["arpu_"] is None
    filled = by_key(DS.fill_missing(DS.outer_dataset(u, _voice(spark), _sms(spark), _app(spark), ["m1", "m2"])))
    assert filled["b"]["arpu_"] == 0 and filled["z"]["label"] is None
    train, test, feats = __import__("phonelens.plans.model", fromlist=["x"]).split_train_test(
        DS.outer_dataset(u, _voice(spark), _sms(spark), _app(spark), ["m1", "m2"]))
    assert sorted(r["phone_no_m"] for r in train.collect()) == ["a", "b", "c"]
    assert "label" not in feats and "phone_no_m" not in feats


def test_baseline_dataset_codes_and_last_month(spark):
    u = DS.with_test_unlabelled(_users(spark))
    ds = by_key(DS.baseline_dataset(u, _voice(spark), _sms(spark), _app(spark), ["m1", "m2"]))
    assert set(ds) == {"a", "b", "c", "t"}
    assert ds["a"]["arpu_last"] == 2.0 and "m1" not in ds["a"]
    # city codes over train and test together: "nan" < "x" < "y"
    assert (ds["b"]["city_name"], ds["a"]["city_name"], ds["c"]["city_name"], ds["t"]["city_name"]) == (0, 1, 2, 1)
    assert ds["a"]["busi_count"] == 1 and ds["b"]["busi_count"] is None


def test_align_columns(spark):
    train = spark.createDataFrame([("a", 1.0, 2.0, 1)], "phone_no_m string, f1 double, arpu_ double, label int")
    test = spark.createDataFrame([("t", 3.0, 4.0, 9.0)], "phone_no_m string, f1 double, arpu_x double, extra double")
    out = DS.align_columns(train, test, rename={"arpu_x": "arpu_"})
    assert out.columns == ["f1", "arpu_"]
    assert out.first()["arpu_"] == 4.0


def test_class_split_keeps_labelled_rows(spark):
    u = _users(spark).filter("split = 'train'")
    got = rows(C.class_split(_voice(spark), u), "phone_no_m", "label")
    assert got == [("a", 1), ("a", 1)]


def test_monthly_flow_change_and_daily_ratio(spark):
    from phonelens.operators import app as A
    from phonelens.operators import voice as V
    app = fx.app(spark, [("a", "w", 10.0, "2020-01"), ("a", "w", 5.0, "2020-01"), ("a", "q", 40.0, "2020-03")])
    got = rows(A.monthly_flow_change(app), "month_id", "month_flow", "flow_change")
    assert got == [("2020-01", 15.0, None), ("2020-03", 40.0, 25.0)]
    log = fx.voice(spark, [("a", "x", 1, fx.ts(1), 1.0, "c", "k", "h"), ("a", "y", 2, fx.ts(1), 1.0, "c", "k", "h"),
                           ("a", "y", 2, fx.ts(1), 1.0, "c", "k", "h"), ("a", "y", 2, fx.ts(2), 1.0, "c", "k", "h")])
    r = by_key(V.daily_in_out_ratio(log))["a"]
    # day 1: 2 called / 1 caller = 2.0; day 2: no caller row -> NULL, left out of the mean
    assert r["in_out_ratio_mean"] == 2.0 and r["active_days"] == 2
