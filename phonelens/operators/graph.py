"""Contact-graph operators.

The source read a pickled graph whose producer is not in its tree: one row
per phone with maps contact -> count for calls made (``out``) and received
(``in``), per channel.  Here the graph is an edge DataFrame built from the
logs.  **Assumption** (stated because the producer is missing): ``out`` =
type-1 rows of the phone's own log, ``in`` = type-2 rows; with
``reverse=True`` other phones' type-1 rows towards the phone count as
``in`` too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonelens.functions.expr import safe_ratio
from phonelens.operators._common import CONTACT, KEY
from phonelens.session import materialize

OUT, IN = "out", "in"


def contact_edges(log: DataFrame, channel: str = "call", reverse: bool = False) -> DataFrame:
    """G1: edges ``(phone_no_m, contact, direction, channel, n)``."""
    v = log.filter(F.col(KEY).isNotNull() & F.col(CONTACT).isNotNull())
    d = F.when(F.col("calltype_id") == 1, F.lit(OUT)).when(F.col("calltype_id") == 2, F.lit(IN))
    own = v.select(F.col(KEY), F.col(CONTACT).alias("contact"), d.alias("direction"))
    if reverse:
        rev = (v.filter(F.col("calltype_id") == 1)
               .select(F.col(CONTACT).alias(KEY), F.col(KEY).alias("contact"), F.lit(IN).alias("direction")))
        own = own.unionByName(rev)
    return (own.filter(F.col("direction").isNotNull())
            .groupBy(KEY, "contact", "direction").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("channel", F.lit(channel)))


def is_pairs(log: DataFrame) -> bool:
    """The table holds pairs of phone and contact, not log rows."""
    return {"n", "n_out", "n_in"} <= set(log.columns)


def edges_of_pairs(pairs: DataFrame, channel: str = "call") -> DataFrame:
    """G1 from stored pairs: the rows of ``contact_edges`` without ``reverse``."""
    sides = F.array(F.struct(F.lit(OUT).alias("direction"), F.col("n_out").alias("n")),
                    F.struct(F.lit(IN).alias("direction"), F.col("n_in").alias("n")))
    p = pairs.filter(F.col(KEY).isNotNull() & F.col(CONTACT).isNotNull())
    return (p.select(KEY, F.col(CONTACT).alias("contact"), F.inline(sides)).filter(F.col("n") > 0)
            .withColumn("channel", F.lit(channel)))


def contact_pairs(log: DataFrame) -> DataFrame:
    """One row per (phone, contact) of the log: rows ``n``, caller rows
    ``n_out``, called rows ``n_in``.  The NULL contact keeps phones whose
    rows all lack a contact.  Every call-back measure derives from this one
    aggregation (one scan, one shuffle of pre-aggregated pairs).  Pairs that
    were stored (``sources.graph_store``) stand for their log."""
    if is_pairs(log):
        return log.select(KEY, CONTACT, "n", "n_out", "n_in")
    return (log.filter(F.col(KEY).isNotNull()).groupBy(KEY, CONTACT)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count_if(F.col("calltype_id") == 1).alias("n_out"),
                 F.count_if(F.col("calltype_id") == 2).alias("n_in")))


def _callbacks_per_phone(pairs: DataFrame) -> DataFrame:
    has = F.col(CONTACT).isNotNull()
    out = has & (F.col("n_out") > 0)
    return pairs.groupBy(KEY).agg(F.count_if(out & (F.col("n_in") > 0)).alias("recall"),
                                  F.count_if(out).alias("call"), F.sum("n").alias("rows"))


def _reciprocated(pairs: DataFrame) -> DataFrame:
    """Rows that a phone's contacts have with it, by one grouping: both
    directions of a pair meet under (lesser, greater) phone.  A phone that
    calls itself is a pair of one direction and counts its own rows."""
    p = pairs.filter(F.col(CONTACT).isNotNull())
    forth = F.col(KEY) <= F.col(CONTACT)
    both = p.groupBy(F.least(KEY, CONTACT).alias("_lo"), F.greatest(KEY, CONTACT).alias("_hi")).agg(
        F.sum(F.when(forth, F.col("n"))).alias("_n_lo"), F.sum(F.when(~forth, F.col("n"))).alias("_n_hi"))
    one = lambda phone, n: F.struct(phone.alias(KEY), n.alias("_n"))
    lo, hi, n_lo, n_hi = (F.col(c) for c in ("_lo", "_hi", "_n_lo", "_n_hi"))
    sides = F.when(lo == hi, F.array(one(lo, n_lo))).otherwise(F.array(one(lo, n_hi), one(hi, n_lo)))
    rows = both.filter((lo == hi) | (n_lo.isNotNull() & n_hi.isNotNull())).select(F.inline(sides))
    return rows.groupBy(KEY).agg(F.sum("_n").alias("recall"))


def callback_count(log: DataFrame) -> DataFrame:
    """Per phone of the log, contacts it called that also called it
    (``recall``) and contacts it called (``call``); distinct contacts."""
    return _callbacks_per_phone(contact_pairs(log)).select(KEY, "recall", "call")


def no_outgoing(log: DataFrame) -> DataFrame:
    """Phones of the log with no outgoing (type-1) edge."""
    if is_pairs(log):
        return _callbacks_per_phone(contact_pairs(log)).filter(F.col("call") == 0).select(KEY)
    phones = log.filter(F.col(KEY).isNotNull()).select(KEY).distinct()
    # de-duplicated before the anti-join: a phone with a third of all caller
    # rows arrives as one row, not as a skewed partition
    callers = log.filter((F.col("calltype_id") == 1) & F.col(CONTACT).isNotNull()).select(KEY).distinct()
    return phones.join(callers, KEY, "left_anti")


def reciprocated_rows(log: DataFrame) -> DataFrame:
    """Per phone, over its distinct contacts, the rows in which that
    contact has the phone as contact; phones with 0 are absent.

    The per-phone, per-contact scan of the source is one grouping of the
    pair counts by unordered pair; a hot contact never multiplies rows."""
    return _reciprocated(contact_pairs(log))


def repeat_ratio(log: DataFrame) -> DataFrame:
    """Distinct contacts / rows per phone (the source's never-filled
    ``res_set_2``)."""
    if is_pairs(log):
        return log.groupBy(KEY).agg(safe_ratio(F.count(CONTACT), F.sum("n")).alias("repeat_ratio"))
    v = log.filter(F.col(KEY).isNotNull())
    return v.groupBy(KEY).agg(safe_ratio(F.count_distinct(CONTACT), F.count(F.lit(1))).alias("repeat_ratio"))


def callback_with_fallback(log: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """The call-back table of the phones in ``log``.  Phones with an
    outgoing edge take G2 (distinct contacts); the others fall back to row
    counts over ``pool`` (the logs of both splits; ``log`` itself when not
    given): ``recall`` = reciprocated rows (G5, 0 if none), ``call`` = the
    phone's rows.  ``re_ratio`` = recall / call, NULL when call is 0.
    ``measure`` says which of the two definitions a row uses.  Each log is
    aggregated to pairs once."""
    # several consumers prune the pairs differently, so Spark would re-read
    # and re-shuffle the log for each; write the pairs once instead
    pairs = materialize(contact_pairs(log))
    wide = pairs if pool is None else materialize(contact_pairs(pool))
    per = _callbacks_per_phone(pairs).drop("rows")
    rows = wide.groupBy(KEY).agg(F.sum("n").alias("rows"))
    per = per.join(rows, KEY, "left").join(_reciprocated(wide).withColumnRenamed("recall", "_rr"), KEY, "left")
    fallback = F.col("call") == 0
    recall = F.when(fallback, F.coalesce(F.col("_rr"), F.lit(0))).otherwise(F.col("recall"))
    call = F.when(fallback, F.coalesce(F.col("rows"), F.lit(0))).otherwise(F.col("call"))
    out = per.select(KEY, recall.alias("recall"), call.alias("call"),
                     F.when(fallback, F.lit("rows")).otherwise(F.lit("distinct_contacts")).alias("measure"))
    return out.select(KEY, "recall", "call", safe_ratio("recall", "call").alias("re_ratio"), "measure")


def callback_share(callbacks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per class, phones with an outgoing contact (``with_out``) and
    those whose call-back share ``(recall/call)·(call/total)`` is not 0
    (``nonzero``).  For call ≠ 0 the share is ``recall/total`` with
    ``total`` > 0 the number of phones, so it is non-zero exactly when
    ``recall`` is; no global count is needed."""
    j = callbacks.join(labels.select(KEY, "label"), KEY)
    return j.groupBy("label").agg(*share_counts())


def share_counts() -> list[Column]:
    """``with_out`` and ``nonzero`` of G7 as aggregates over recall and call."""
    out = F.col("call") != 0
    return [F.count_if(out).alias("with_out"), F.count_if(out & (F.col("recall") != 0)).alias("nonzero")]


def callback_times_ratio(callbacks: DataFrame) -> DataFrame:
    """G8 (commented): ``kkk = call * re_ratio``."""
    return callbacks.select(KEY, (F.col("call") * F.col("re_ratio")).alias("kkk"))
