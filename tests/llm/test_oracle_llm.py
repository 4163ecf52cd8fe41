"""Every query that SQL can express against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from phonelens.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(Q.ORACLE_SQL[name])
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    clean = lambda rows: sorted((tuple(str(v) if not (isinstance(v, float) and math.isnan(v)) else "" for v in r) for r in rows))
    assert clean(want.select(*cols).fetchall()) == clean(tuple(r) for r in got.select(*cols).collect())
