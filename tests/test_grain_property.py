"""The one-scan grain aggregation equals plain per-feature queries on random
logs with NULLs in every column (hypothesis)."""

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonelens.operators import voice as V
from tests.fixtures import VOICE_SCHEMA

row = st.tuples(
    st.sampled_from(["a", "b", "c", None]),
    st.sampled_from(["x", "y", "z", "w", None]),
    st.sampled_from([1, 2, 3, None]),
    st.one_of(st.none(), st.builds(lambda d, h: datetime(2020, 1, d, h), st.integers(1, 4), st.integers(0, 3))),
    st.one_of(st.none(), st.sampled_from([0.0, 2.0, 4.0, 7.0, 30.0])),
    st.sampled_from(["c1", "c2", None]),
    st.sampled_from(["k1", "k2", None]),
    st.sampled_from(["h1", "h2", "h3", None]),
)


def _plain(df):
    t1 = F.col("calltype_id") == 1
    t2 = F.col("calltype_id") == 2
    d = F.to_date("start_datetime")
    g = df.filter(F.col("phone_no_m").isNotNull()).groupBy("phone_no_m").agg(
        F.count_distinct("opposite_no_m").alias("oppsite_no_m_voc_nunique"),
        F.when(F.count_if(t1) > 0, F.count_distinct(F.when(t1, F.col("opposite_no_m")))).alias("call_diff_01"),
        F.when(F.count_if(t2) > 0, F.count_distinct(F.when(t2, F.col("opposite_no_m")))).alias("call_diff_02"),
        F.count("start_datetime").alias("start_datetime_count"),
        F.count_distinct(d).alias("date_unique"),
        F.count_distinct("city_name").alias("city_name_nunique"),
        F.count_distinct("county_name").alias("county_name_nunique"),
        F.count_distinct("imei_m").alias("imei_m_nunique"),
        F.coalesce(F.sum("call_dur"), F.lit(0.0)).alias("dure_sum"))
    return {r["phone_no_m"]: r.asDict() for r in g.collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=25))
def test_voice_b_equals_plain_queries(spark, rows):
    df = spark.createDataFrame(rows, VOICE_SCHEMA)
    got = {r["phone_no_m"]: r.asDict() for r in V.voice_features_b(df).collect()}
    want = _plain(df)
    assert set(got) == set(want)
    for k, w in want.items():
        for c, v in w.items():
            assert got[k][c] == v, (k, c, got[k][c], v)
