"""Blocks do not depend on row order or partition count; row universes."""

from pyspark.sql import functions as F

from phonelens.operators import graph as G
from phonelens.operators import voice as V
from phonelens.sources import views

SF = "/root/testdata/sf0.001"


def _same(a, b):
    ra = sorted(map(tuple, a.collect()), key=repr)
    rb = sorted(map(tuple, b.collect()), key=repr)
    assert ra == rb


def test_blocks_independent_of_partitioning(spark):
    log = views.voice(spark, SF)
    shuffled = log.repartition(13, F.rand(seed=3))
    _same(V.voice_features_b(log), V.voice_features_b(shuffled))
    _same(V.voice_features_a(log.coalesce(1)), V.voice_features_a(shuffled))


def test_feature_rows_are_distinct_keys(spark):
    log = views.voice(spark, SF)
    phones = log.filter(F.col("phone_no_m").isNotNull()).select("phone_no_m").distinct().count()
    assert V.voice_features_b(log).count() == phones
    assert G.callback_count(log).count() == phones


def test_callback_bounded_by_calls(spark):
    cb = G.callback_count(views.voice(spark, SF))
    assert cb.filter(F.col("recall") > F.col("call")).count() == 0


def test_two_level_matches_block_columns(spark):
    from phonelens.operators import stats as ST
    log = views.voice(spark, SF)
    tl = {r["phone_no_m"]: r for r in ST.two_level(log, "phone_no_m", "opposite_no_m", "call_dur", "p").collect()}
    fa = {r["phone_no_m"]: r for r in V.voice_features_a(log).collect()}
    assert set(tl) == set(fa)
    for k, r in fa.items():
        assert tl[k]["p_count_max"] == r["phone2opposite_max"]
        assert abs(tl[k]["p_count_mean"] - r["phone2opposite_mean"]) < 1e-9
        assert tl[k]["p_count_median"] == r["phone2opposite_median"]
        assert abs(tl[k]["p_sum_mean"] - r["phone2oppo_sum_mean"]) < 1e-6
        assert tl[k]["p_sum_median"] == r["phone2oppo_sum_median"]
