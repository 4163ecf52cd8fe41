"""The driver contract of __spark_entry__.py."""

import __spark_entry__ as E

ROWS_ONLY = {"train_score_gbt", "submission", "feature_importance"}


def test_every_oracle_has_a_query_and_back():
    q, o = set(E.queries()), set(E.oracle_sql())
    assert o <= q
    assert (q & set(E.REGISTRY)) - o == ROWS_ONLY


def test_entry_schema_is_stable(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert "phone_no_m" in a.columns and a.count() == 150
