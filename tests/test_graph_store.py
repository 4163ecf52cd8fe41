"""A stored contact graph: batches merged equal one build, operators read it."""

import os
import tempfile

import numpy as np
import pytest

from phonelens.operators import graph as G
from phonelens.sources import graph_store as S

SCHEMA = "phone_no_m string, opposite_no_m string, calltype_id int"


def _path():
    return os.path.join(tempfile.mkdtemp(prefix="phonelens-graph-", dir="/tmp"), "graph")


def _log(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        phone = "hot" if i % 3 == 0 else f"p{rng.integers(12)}"
        contact = None if rng.random() < 0.1 else ("hot" if rng.random() < 0.2 else f"p{rng.integers(15)}")
        rows.append((phone, contact, int(rng.integers(1, 4))))
    return [*rows, (None, "p1", 1), ("lone", None, 1), ("self", "self", 1), ("self", "self", 2)]


def _set(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_two_batches_equal_one_build_for_all_operators(spark):
    first, second = (spark.createDataFrame(_log(200, s), SCHEMA) for s in (1, 2))
    both = first.unionByName(second)
    path = _path()
    S.merge_log(spark, path, first, "day1", buckets=8)
    S.merge_log(spark, path, second, "day2", buckets=8)
    assert S.merged_batches(spark, path) == ["day1", "day2"]
    stored = S.load_pairs(spark, path)
    assert _set(stored) == _set(G.contact_pairs(both))
    assert _set(G.edges_of_pairs(stored)) == _set(G.contact_edges(both))
    for op in (G.callback_count, G.callback_with_fallback, G.no_outgoing, G.reciprocated_rows, G.repeat_ratio):
        assert _set(op(stored)) == _set(op(both)), op.__name__
    assert _set(G.callback_times_ratio(G.callback_with_fallback(stored))) == _set(
        G.callback_times_ratio(G.callback_with_fallback(both)))


def _files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_folders_are_rewritten(spark):
    path = _path()
    S.merge_log(spark, path, spark.createDataFrame([(f"p{i}", "x", 1) for i in range(60)], SCHEMA), "day1", buckets=8)
    before = _files(path)
    assert S.merge_log(spark, path, spark.createDataFrame([("p5", "x", 2)], SCHEMA), "day2", buckets=8) == 1
    gone = before - _files(path)
    assert len({os.path.dirname(f) for f in gone}) == 2          # p5's folder and the list of batches
    got = {r.phone_no_m: (r.n, r.n_out, r.n_in) for r in S.load_pairs(spark, path).collect()}
    assert len(got) == 60 and got["p5"] == (2, 1, 1) and got["p6"] == (1, 1, 0)


def test_a_batch_counts_once_and_folders_stay(spark):
    path = _path()
    log = spark.createDataFrame([("p1", "x", 1)], SCHEMA)
    S.merge_log(spark, path, log, "day1", buckets=8)
    with pytest.raises(ValueError, match="already"):
        S.merge_log(spark, path, log, "day1", buckets=8)
    with pytest.raises(ValueError, match="folders"):
        S.merge_log(spark, path, log, "day2", buckets=16)
    with pytest.raises(ValueError, match="types"):
        S.merge_log(spark, path, log.selectExpr("1L AS phone_no_m", "opposite_no_m", "calltype_id"), "day2", buckets=8)
    assert S.load_pairs(spark, path).first().n == 1


def test_channels_and_empty_batches(spark):
    path = _path()
    assert S.merged_batches(spark, path) == []
    log = spark.createDataFrame([("p1", "x", 1)], SCHEMA)
    S.merge_log(spark, path, log.limit(0), "none", buckets=8)
    assert S.load_pairs(spark, path).count() == 0
    S.merge_log(spark, path, log, "calls", buckets=8)
    S.merge_log(spark, path, log.unionByName(log), "texts", channel="sms", buckets=8)
    assert S.load_pairs(spark, path).first().n == 1 and S.load_pairs(spark, path, "sms").first().n == 2
    assert S.merged_batches(spark, path) == ["calls", "none", "texts"]
