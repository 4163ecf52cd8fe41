"""The first flow end to end on small CSV tables in the source's layout."""

import os
import tempfile

import numpy as np
import pytest

from phonelens.plans.flows import first_flow
from phonelens.plans.model import TreeParams
from phonelens.sources.schemas import ARPU_MONTHS


def _csv(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


TEST_PHONES = [f"t{i}" for i in range(12)]


@pytest.fixture(scope="module")
def tables():
    """The eight source tables as CSV with headers in a fresh folder."""
    rng = np.random.default_rng(3)
    d = tempfile.mkdtemp(prefix="phonelens-flow-", dir="/tmp")
    train = [f"p{i}" for i in range(60)]
    test = TEST_PHONES
    labels = {p: int(i % 4 == 0) for i, p in enumerate(train)}
    _csv(os.path.join(d, "train_user.csv"),
         ["phone_no_m", "city_name", "county_name", "idcard_cnt", *ARPU_MONTHS, "label"],
         [(p, f"c{i % 3}", f"k{i % 2}", 1, *[round(float(rng.uniform(10, 99)), 2)] * 8, labels[p])
          for i, p in enumerate(train)])
    _csv(os.path.join(d, "test_user.csv"), ["phone_no_m", "city_name", "county_name", "idcard_cnt", "arpu_202004"],
         [(p, "c1", None, 1, 20.5) for p in test])
    voc_h = ["phone_no_m", "opposite_no_m", "calltype_id", "start_datetime", "call_dur", "city_name",
             "county_name", "imei_m"]
    sms_h = ["phone_no_m", "opposite_no_m", "calltype_id", "request_datetime"]
    app_h = ["phone_no_m", "busi_name", "flow", "month_id"]
    for split, phones in (("train", train), ("test", test)):
        voc, sms, app = [], [], []
        for p in phones:
            short = labels.get(p, 0)
            for j in range(6):
                voc.append((p, f"o{j}", 1 + j % 2, f"2020-01-0{1 + j % 5} 0{j}:00:00", 2 if short else 60 + j,
                            "c", "k", f"h{j % 2}"))
                sms.append((p, f"o{j}", 1 + j % 2, f"2020-01-0{1 + j % 5} 1{j}:00:00"))
            app.append((p, "w", 10.5, "2020-01"))
        _csv(os.path.join(d, f"{split}_voc.csv"), voc_h, voc)
        _csv(os.path.join(d, f"{split}_sms.csv"), sms_h, sms)
        _csv(os.path.join(d, f"{split}_app.csv"), app_h, app)
    return d


def test_first_flow_on_csv_tables(spark, tables):
    d = tables
    out = os.path.join(d, "out")
    res = first_flow(spark, d, out, params=TreeParams(max_iter=5, min_instances=2))
    sub = spark.read.option("header", True).csv(os.path.join(out, "submission"))
    assert sorted(r["phone_no_m"] for r in sub.collect()) == sorted(TEST_PHONES)
    assert res.fold_scores.count() == 5


def test_second_flow_on_csv_tables(spark, tables):
    from phonelens.plans.flows import second_flow
    d = tables
    out = os.path.join(d, "out2")
    res = second_flow(spark, d, out, params=TreeParams(max_iter=3, min_instances=2, feature_subset="all",
                                                       subsampling_rate=1.0, max_bins=32))
    sub = spark.read.option("header", True).csv(os.path.join(out, "second_submission"))
    assert sub.columns == ["phone_no_m", "label"] and sub.count() == 12
    assert all(-0.3 <= float(r["label"]) <= 0.7 for r in sub.collect())
    assert res.importances.count() > 0


def test_coverage_and_segment_flows(spark, tables):
    from phonelens.plans.flows import coverage_flow, segment_flow
    cov, test_cov = coverage_flow(spark, tables)
    assert {r["log"]: r["missing"] for r in cov.collect()} == {"voc": 0, "sms": 0, "app": 0}
    assert test_cov.first()["missing"] == 0
    rep = {(r["part"], r["label"], r["metric"]): r["value"] for r in segment_flow(spark, tables).collect()}
    # every training phone has one app month: all are in the low-usage segment
    assert rep[("app_months", 0, "low_usage")] + rep[("app_months", 1, "low_usage")] == 60
    assert rep[("voice_contacts", 1, "over_bound")] == 0


def test_feature_and_recall_runs_load_by_name(spark, tables):
    from phonelens.plans.flows import feature_tables, recall_flow, second_flow
    from phonelens.sources.loader import load
    out = os.path.join(tables, "named")
    feature_tables(spark, tables, out)
    assert load(spark, out, "test_voice_features").count() == 12
    assert {"phone_no_m", "busi_count"} <= set(load(spark, out, "train_app_features").columns)
    recall_flow(spark, tables, out)
    calls = {r["phone_no_m"]: r for r in load(spark, out, "train_recall_call").collect()}
    # three contacts called (j = 0, 2, 4), none of which also called
    assert len(calls) == 60 and calls["p0"]["call"] == 3 and calls["p0"]["recall"] == 0
    assert load(spark, out, "test_recall_sms").count() == 12
    res = second_flow(spark, tables, out, params=TreeParams(max_iter=2, min_instances=2), recall=out)
    assert res.submission.count() == 12 and "recall" in load(spark, out, "train_dataset").columns
    plain = load(spark, out, "train_dataset")
    want = sorted(str(tuple(r[c] for c in sorted(plain.columns))) for r in plain.collect())
    bucketed = os.path.join(tables, "bucketed")
    second_flow(spark, tables, bucketed, params=TreeParams(max_iter=2, min_instances=2), recall=out, buckets=3)
    again = load(spark, bucketed, "train_dataset")
    assert sorted(str(tuple(r[c] for c in sorted(again.columns))) for r in again.collect()) == want


def test_fallback_counts_rows_of_both_splits(spark):
    from phonelens.operators.graph import callback_with_fallback
    schema = "phone_no_m string, opposite_no_m string, calltype_id int"
    train = spark.createDataFrame([("a", "t", 2), ("a", "t", 2), ("b", "a", 1)], schema)
    test = spark.createDataFrame([("t", "a", 1), ("t", "a", 3)], schema)
    got = {r["phone_no_m"]: r for r in callback_with_fallback(train, train.unionByName(test)).collect()}
    # a never called out: its 2 rows, and t's 2 rows with it
    assert set(got) == {"a", "b"} and (got["a"]["recall"], got["a"]["call"], got["a"]["measure"]) == (2, 2, "rows")
    assert (got["b"]["recall"], got["b"]["call"]) == (0, 1)


def test_two_hundred_counties(spark):
    import pyspark.sql.functions as F
    from phonelens.plans.model import kfold_train_score
    rows = spark.range(400).select(F.concat(F.lit("p"), "id").alias("phone_no_m"), (F.col("id") % 200).cast("int").alias("county_name"),
                                   (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    res = kfold_train_score(rows, rows.drop("label"), ["county_name", "x"], k=2, params=TreeParams(max_iter=2, min_instances=1),
                            categorical={"county_name": 200})
    assert res.submission.count() == 400
