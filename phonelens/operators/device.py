"""Handset operators (H1-H3 and the dead F7 handset maxima)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens import constants as K
from phonelens.functions.expr import date_of, safe_ratio
from phonelens.operators._common import KEY
from phonelens.session import materialize

IMEI = "imei_m"


def handset_day_max(log: DataFrame) -> DataFrame:
    """Dead F7 ``phone_count_max``: most calls made on one handset in one
    day (the source's name says "phones"; it counts calls)."""
    v = (log.select(KEY, IMEI, date_of("start_datetime").alias("_date"))
         .filter(F.col(KEY).isNotNull() & F.col(IMEI).isNotNull() & F.col("_date").isNotNull()))
    per = v.groupBy(KEY, "_date", IMEI).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(KEY).agg(F.max("_n").alias("phone_count_max"))


def handset_county_max(log: DataFrame) -> DataFrame:
    """Dead F7 ``imei_county_mean``: most calls on one handset in one county
    (a maximum, whatever the source's name says)."""
    v = log.filter(F.col(KEY).isNotNull() & F.col(IMEI).isNotNull() & F.col("county_name").isNotNull())
    per = v.groupBy(KEY, IMEI, "county_name").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(KEY).agg(F.max("_n").alias("imei_county_mean"))


def phones_per_handset(log: DataFrame, more_than: int = K.SHARED_HANDSET_PHONES_OVER) -> DataFrame:
    """H2: distinct phones per handset, handsets with more than
    ``more_than`` phones."""
    pairs = log.filter(F.col(KEY).isNotNull() & F.col(IMEI).isNotNull()).select(KEY, IMEI).distinct()
    return (pairs.groupBy(IMEI).agg(F.count(F.lit(1)).alias("phones"))
            .filter(F.col("phones") > more_than))


def shared_handset_score(log: DataFrame) -> DataFrame:
    """H1: per phone, over its rows, the mean number of phones seen on the
    row's handset, counting 0 for a handset used by this phone alone.

    Rows with a NULL handset add 0 but stay in the divisor.  The per-row
    lookup of the source becomes: rows per (phone, handset) ⋈ phones per
    handset, then a sum per phone.  A handset shared by very many phones is
    one row per phone on the left and one row on the right, so the join
    never multiplies rows; AQE splits it if it is skewed.
    """
    pairs = materialize(log.filter(F.col(KEY).isNotNull()).groupBy(KEY, IMEI)
                        .agg(F.count(F.lit(1)).alias("_rows")))   # read twice below
    per_handset = (pairs.filter(F.col(IMEI).isNotNull()).groupBy(IMEI)
                   .agg(F.count(F.lit(1)).alias("_phones")))
    j = pairs.join(per_handset, IMEI, "left")
    shared = F.when(F.col("_phones") > 1, F.col("_rows") * F.col("_phones")).otherwise(F.lit(0))
    return j.groupBy(KEY).agg(safe_ratio(F.sum(shared), F.sum("_rows")).alias("imei_phone"))


def handsets_per_phone_by_class(log: DataFrame, labels: DataFrame,
                                more_than: int = K.SOURCE_HANDSETS_OVER) -> DataFrame:
    """Per class, phones of the class-split voice log with more
    than ``more_than`` distinct handsets, and all phones of that log."""
    per_phone = (log.filter(F.col(KEY).isNotNull()).groupBy(KEY)
                 .agg(F.count_distinct(IMEI).alias("_handsets"))
                 .join(labels.select(KEY, "label"), KEY))
    return per_phone.groupBy("label").agg(
        F.count_if(F.col("_handsets") > more_than).alias("phones_over"),
        F.count(F.lit(1)).alias("phones"))
