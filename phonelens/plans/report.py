"""

The source printed it line by line: low-usage phones per class, their
voice / SMS contact counts, their call-back counts and handset changes.
Here each part is a small per-class DataFrame, stacked as
``(part, label, metric, value)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens import constants as K
from phonelens.operators import coverage as C
from phonelens.operators import device as D


def _long(df: DataFrame, part: str) -> DataFrame:
    metrics = [c for c in df.columns if c != "label"]
    return (df.select("label", *[F.col(c).cast("long").alias(c) for c in metrics])
            .unpivot(["label"], metrics, "metric", "value")
            .select(F.lit(part).alias("part"), "label", "metric", "value"))


def segment_report(labels: DataFrame, app: DataFrame, voice: DataFrame, sms: DataFrame,
                   max_months: int = K.LOW_USAGE_MONTHS, contacts_over: int = K.SOURCE_CONTACTS_OVER,
                   handsets_over: int = K.SOURCE_HANDSETS_OVER) -> DataFrame:
    """C4-C8 for the labelled users: app usage, the low-usage segment's
    voice and SMS contacts, its call-backs, and handsets per phone."""
    segment = C.low_usage_phones(labels, app, max_months)
    parts = [
        _long(C.low_usage_segment(labels, app, max_months), "app_months"),
        _long(C.segment_contacts(segment, voice, labels, contacts_over), "voice_contacts"),
        _long(C.segment_contacts(segment, sms, labels, contacts_over), "sms_contacts"),
        _long(C.segment_callback(segment, voice), "callback"),
        _long(D.handsets_per_phone_by_class(voice, labels, handsets_over), "handsets"),
    ]
    return reduce(DataFrame.unionByName, parts)
