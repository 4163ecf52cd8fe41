"""Hand-made tables (FIXTURES.md section 3), each a few rows."""

from datetime import datetime

from pyspark.sql import types as T

VOICE_SCHEMA = ("phone_no_m string, opposite_no_m string, calltype_id int, start_datetime timestamp_ntz, "
                "call_dur double, city_name string, county_name string, imei_m string")
SMS_SCHEMA = "phone_no_m string, opposite_no_m string, calltype_id int, request_datetime timestamp_ntz"
APP_SCHEMA = "phone_no_m string, busi_name string, flow double, month_id string"


def ts(day, hour=0):
    return datetime(2020, 1, day, hour, 0, 0)


def voice(spark, data):
    return spark.createDataFrame(data, VOICE_SCHEMA)


def sms(spark, data):
    return spark.createDataFrame(data, SMS_SCHEMA)


def app(spark, data):
    return spark.createDataFrame(data, APP_SCHEMA)


def null_key_voice(spark):
    return voice(spark, [
        (None, "x", 1, ts(1), 10.0, "c", "k", "h1"),
        ("a", "x", 1, ts(1), 10.0, "c", "k", "h1"),
    ])


def one_row_voice(spark):
    return voice(spark, [("a", "x", 1, ts(3, 5), 7.0, "c", "k", "h1")])


def mode_tie_sms(spark):
    # hours 3, 3, 1, 1 -> mode 1 with count 2
    return sms(spark, [("a", "x", 1, ts(1, 3)), ("a", "y", 1, ts(2, 3)),
                       ("a", "x", 2, ts(3, 1)), ("a", "z", 2, ts(4, 1))])


def all_null_dur_voice(spark):
    return voice(spark, [("a", "x", 1, ts(1), None, "c", "k", "h1"),
                         ("a", "y", 2, ts(2), None, "c", "k", "h1")])


def no_caller_voice(spark):
    return voice(spark, [("a", "x", 2, ts(1), 3.0, "c", "k", "h1"),
                         ("a", "y", 2, ts(2), 30.0, "c", "k", "h2")])


def no_short_voice(spark):
    return voice(spark, [("a", "x", 1, ts(1), 6.0, "c", "k", "h1"),
                         ("a", "y", 1, ts(2), 60.0, "c", "k", "h1"),
                         ("b", "y", 1, ts(2), 2.0, "c", "k", "h1"),
                         ("b", "y", 1, ts(2), 20.0, "c", "k", "h1")])


def graph_small_voice(spark):
    # a->b, b->a, a->c, c->d, a->a, a->b again (type 1 = caller rows of the
    # first phone; the receiving side logs the same call as type 2)
    calls = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("a", "a"), ("a", "b")]
    out = []
    for i, (s, d) in enumerate(calls):
        out.append((s, d, 1, ts(1 + i), 10.0, "c", "k", "h" + s))
        out.append((d, s, 2, ts(1 + i), 10.0, "c", "k", "h" + d))
    return voice(spark, out)


def handset_small_voice(spark):
    # handset h1: phone a only; handset h3: phones a, b, c; one NULL handset row of a
    return voice(spark, [
        ("a", "x", 1, ts(1), 1.0, "c", "k", "h1"),
        ("a", "x", 1, ts(2), 1.0, "c", "k", "h3"),
        ("a", "x", 1, ts(3), 1.0, "c", "k", None),
        ("b", "x", 1, ts(1), 1.0, "c", "k", "h3"),
        ("c", "x", 1, ts(1), 1.0, "c", "k", "h3"),
        ("c", "x", 1, ts(2), 1.0, "c", "k", "h3"),
    ])


# 20 scores with ties and labels (M9 against a brute-force loop)
SCORES_20 = [
    (0.91, 1), (0.85, 1), (0.85, 0), (0.80, 1), (0.72, 0), (0.70, 1), (0.70, 1), (0.66, 0), (0.61, 0),
    (0.55, 1), (0.52, 0), (0.47, 0), (0.47, 1), (0.40, 0), (0.33, 0), (0.31, 1), (0.25, 0), (0.12, 0),
    (0.05, 0), (0.01, 0),
]


def scores_20(spark):
    return spark.createDataFrame([(f"p{i:02d}", s, y) for i, (s, y) in enumerate(SCORES_20)],
                                 "phone_no_m string, prob double, label int")
