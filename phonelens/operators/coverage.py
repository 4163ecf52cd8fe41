"""Coverage and class-segment reports (C1-C8): what the source printed,
returned as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens import constants as K
from phonelens.operators import graph
from phonelens.operators._common import CONTACT, KEY
from phonelens.session import materialize


def class_split(log: DataFrame, labels: DataFrame) -> DataFrame:
    """The log's rows with their phone's class (the source read
    per-class copies of each log)."""
    return log.join(labels.select(KEY, "label"), KEY)


def _phones(log: DataFrame) -> DataFrame:
    return log.filter(F.col(KEY).isNotNull()).select(KEY).distinct()


def log_coverage(users: DataFrame, logs: dict[str, DataFrame]) -> DataFrame:
    """Per log, labelled users with no row in it and scam numbers
    (label 1) among them."""
    parts = []
    for name, log in logs.items():
        missing = users.select(KEY, "label").join(_phones(log), KEY, "left_anti")
        parts.append(missing.agg(F.count(F.lit(1)).alias("missing"),
                                 F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("missing_scam"))
                     .select(F.lit(name).alias("log"), "missing", "missing_scam"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def test_coverage(test_users: DataFrame, log: DataFrame) -> DataFrame:
    """Test users with no row in the log."""
    return (test_users.select(KEY).distinct().join(_phones(log), KEY, "left_anti")
            .agg(F.count(F.lit(1)).alias("missing")))


def months_per_phone(users: DataFrame, app_log: DataFrame) -> DataFrame:
    """Users with their number of app months; 0 for users absent from the
    app log (the source started from the log and so never saw them)."""
    months = (app_log.filter(F.col(KEY).isNotNull()).groupBy(KEY)
              .agg(F.count_distinct("month_id").alias("_months")))
    return (users.select(KEY, "label").join(months, KEY, "left")
            .select(KEY, "label", F.coalesce(F.col("_months"), F.lit(0)).alias("months"),
                    F.col("_months").isNotNull().alias("in_app")))


def low_usage_phones(users: DataFrame, app_log: DataFrame, max_months: int = K.LOW_USAGE_MONTHS) -> DataFrame:
    """Segment: labelled users with fewer than ``max_months`` app months."""
    return months_per_phone(users, app_log).filter(F.col("months") < max_months).select(KEY, "label")


def low_usage_segment(users: DataFrame, app_log: DataFrame, max_months: int = K.LOW_USAGE_MONTHS) -> DataFrame:
    """C4: per class, users, users in the app log, and users with fewer
    than ``max_months`` months (0 included)."""
    m = months_per_phone(users, app_log)
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("users"),
                                  F.count_if("in_app").alias("app_phones"),
                                  F.count_if(F.col("months") < max_months).alias("low_usage"))


def segment_contacts(segment: DataFrame, log: DataFrame, labels: DataFrame,
                     more_than: int = K.SOURCE_CONTACTS_OVER) -> DataFrame:
    """Per class, segment phones, those with more than
    ``more_than`` distinct contacts in ``log``, those with none, and all
    phones of the class-split log."""
    # one row per phone of the log: feeds both the segment and the class counts
    contacts = materialize(log.filter(F.col(KEY).isNotNull()).groupBy(KEY)
                           .agg(F.count_distinct(CONTACT).alias("_contacts")))
    seg = (segment.select(KEY, "label").join(contacts, KEY, "left")
           .select("label", F.coalesce(F.col("_contacts"), F.lit(0)).alias("contacts")))
    seg_stats = seg.groupBy("label").agg(F.count(F.lit(1)).alias("segment_phones"),
                                         F.count_if(F.col("contacts") > more_than).alias("over_bound"),
                                         F.count_if(F.col("contacts") == 0).alias("no_contact"))
    class_log = (contacts.select(KEY).join(labels.select(KEY, "label"), KEY)
                 .groupBy("label").agg(F.count(F.lit(1)).alias("log_phones")))
    return seg_stats.join(class_log, "label", "full")


def segment_callback(segment: DataFrame, log: DataFrame) -> DataFrame:
    """Call-back counts (G2) of the segment's phones, G7 per class.
    Segment phones with no voice row count as (0, 0)."""
    cb = graph.callback_count(log)
    seg = (segment.select(KEY, "label").join(cb, KEY, "left")
           .select("label", F.coalesce(F.col("recall"), F.lit(0)).alias("recall"),
                   F.coalesce(F.col("call"), F.lit(0)).alias("call")))
    return seg.groupBy("label").agg(*graph.share_counts())
