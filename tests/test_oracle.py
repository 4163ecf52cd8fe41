"""Every registered query with an oracle equals its DuckDB twin on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SLOW = {"train_score_gbt", "submission", "feature_importance"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return "NULL" if v is None else str(v)


def _canon(cols, rs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rs)


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) & set(E.REGISTRY)))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == _canon(cols, res.fetchall())


def test_every_query_runs_and_entry(spark):
    assert E.entry(spark).count() > 0
    for name in sorted(set(E.REGISTRY) - set(E.oracle_sql()) - SLOW):
        assert E.queries()[name](spark, SF).count() >= 0
