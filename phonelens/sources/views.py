"""Call-record views over the shared test tables.

The shared tables are TPC-H-like; these views only rename and re-type their
columns into the call-record schemas the operators expect (see FIXTURES.md).
They do none of the operators' work.  Phones are ``long`` ids here; every
operator is agnostic to the key's type.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order priorities pivoted into monthly-ARPU stand-ins.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ARPU_COLS = ["arpu_1", "arpu_2", "arpu_3", "arpu_4", "arpu_5"]
TEST_MODULUS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _calltype_from_flag(flag: Column) -> Column:
    return F.when(flag == "A", 1).when(flag == "R", 2).when(flag == "N", 3).cast("int")


def voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voice = lineitem ⋈ orders ⋈ supplier ⋈ nation (of the supplier)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(n, s.s_nationkey == n.n_nationkey))
    return j.select(
        F.col("o_custkey").alias("phone_no_m"),
        F.col("l_partkey").alias("opposite_no_m"),
        _calltype_from_flag(F.col("l_returnflag")).alias("calltype_id"),
        F.col("l_shipdate").alias("start_datetime"),
        F.col("l_quantity").alias("call_dur"),
        F.col("n_name").alias("city_name"),
        F.col("s_name").alias("county_name"),
        F.col("l_suppkey").alias("imei_m"),
    )


def sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sms = events; contact is ``k`` of the JSON props."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "props")
    et = F.col("event_type")
    return e.select(
        F.col("user_id").alias("phone_no_m"),
        F.get_json_object("props", "$.k").cast("long").alias("opposite_no_m"),
        F.when(et.isin("click", "purchase"), 1).when(et.isin("view", "signup"), 2)
        .otherwise(3).cast("int").alias("calltype_id"),
        F.col("ts").alias("request_datetime"),
    )


def app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """app = lineitem ⋈ orders ⋈ part."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("o_custkey").alias("phone_no_m"),
        F.col("p_brand").alias("busi_name"),
        F.col("l_extendedprice").alias("flow"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month_id"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user = customer ⋈ nation, with order totals per priority as ARPU
    columns and ``split`` = test for every fifth customer id."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    arpu = (table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
            .groupBy("o_custkey").pivot("o_orderpriority", PRIORITIES).agg(F.sum("o_totalprice")))
    for p, name in zip(PRIORITIES, ARPU_COLS):
        arpu = arpu.withColumnRenamed(p, name)
    base = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    out = base.join(arpu, base.c_custkey == arpu.o_custkey, "left")
    return out.select(
        F.col("c_custkey").alias("phone_no_m"),
        F.col("n_name").alias("city_name"),
        F.col("c_mktsegment").alias("county_name"),
        *[F.col(a) for a in ARPU_COLS],
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("int").alias("label"),
        F.when(F.col("c_custkey") % TEST_MODULUS == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone, label and split only (the user view without its joins)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return c.select(
        F.col("c_custkey").alias("phone_no_m"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("int").alias("label"),
        F.when(F.col("c_custkey") % TEST_MODULUS == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )


def train_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled (training) users: phone and label."""
    return labels(spark, sf_dir).filter(F.col("split") == "train").drop("split")


def test_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test users carry no label, like the source's test table."""
    return labels(spark, sf_dir).filter(F.col("split") == "test").drop("split", "label")


VIEWS = {"voice": voice, "sms": sms, "app": app, "users": users}
