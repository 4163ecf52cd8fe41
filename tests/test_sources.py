"""Sources and sinks: fixed-schema CSV load, unknown names, round trips."""

import os
import tempfile

import pytest

from phonelens.sources import load, load_log_pair, sinks


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_load_csv_with_schema_and_pair(spark):
    d = tempfile.mkdtemp(prefix="phonelens-src-", dir="/tmp")
    head = "phone_no_m,opposite_no_m,calltype_id,start_datetime,call_dur,city_name,county_name,imei_m\n"
    _write(os.path.join(d, "train_voc.csv"), head + "p1,p2,1,2020-01-02 03:04:05,12,c,k,h\n")
    _write(os.path.join(d, "test_voc.csv"), head + "p3,p1,2,2020-01-03 00:00:00,,c,k,h\n")
    tr = load(spark, d, "train_voc")
    assert dict(tr.dtypes)["calltype_id"] == "int" and dict(tr.dtypes)["start_datetime"] == "timestamp_ntz"
    r = tr.first()
    assert r["call_dur"] == 12.0 and r["start_datetime"].hour == 3
    both = load_log_pair(spark, d, "voc")
    assert both.count() == 2
    assert both.filter("call_dur IS NULL").count() == 1


def test_unknown_table_raises(spark):
    with pytest.raises(ValueError):
        load(spark, "/tmp", "train_foo")


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp(prefix="phonelens-sink-", dir="/tmp")
    df = spark.createDataFrame([("a", 0.5, True, "train"), ("b", 0.1, False, "test")],
                               "phone_no_m string, prob double, label boolean, split string")
    sinks.write_table(df, os.path.join(d, "feat"), partition_by=["split"])
    back = spark.read.parquet(os.path.join(d, "feat"))
    assert sorted(r["phone_no_m"] for r in back.collect()) == ["a", "b"]
    sinks.write_submission(df.select("phone_no_m", "label"), os.path.join(d, "sub"))
    csv = spark.read.option("header", True).csv(os.path.join(d, "sub"))
    assert sorted(r["phone_no_m"] for r in csv.collect()) == ["a", "b"]


def test_parquet_round_trip_through_load(spark):
    d = tempfile.mkdtemp(prefix="phonelens-pq-", dir="/tmp")
    df = spark.createDataFrame([("a", "w", 1.5, "2020-01")], "phone_no_m string, busi_name string, flow double, month_id string")
    df.write.parquet(os.path.join(d, "train_app.parquet"))
    back = load(spark, d, "train_app", fmt="parquet")
    assert back.first()["flow"] == 1.5
    with pytest.raises(ValueError):
        load(spark, d, "train_app", fmt="orc")


def test_write_submissions(spark):
    from phonelens.plans.model import write_submissions
    d = tempfile.mkdtemp(prefix="phonelens-subm-", dir="/tmp")
    sub = spark.createDataFrame([("a", 0.7, True), ("b", 0.2, False)], "phone_no_m string, prob double, label boolean")
    write_submissions(sub, d)
    prob = spark.read.option("header", True).csv(os.path.join(d, "prob_submission"))
    dec = spark.read.option("header", True).csv(os.path.join(d, "submission"))
    assert prob.columns == ["phone_no_m", "prob"] and dec.columns == ["phone_no_m", "label"]
    assert sorted(r["label"] for r in dec.collect()) == ["false", "true"]
