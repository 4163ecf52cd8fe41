"""Generic per-key aggregates: mode, value counts, aggregates of aggregates.

All are two map-side-combined aggregations; no key's rows are gathered in
one place, so a key holding a third of the table costs the same as any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonelens.functions.expr import zero_sum
from phonelens.functions.ranking import exact_quantiles
from phonelens.session import materialize


def value_mode(df: DataFrame, key: str, value: Column | str, prefix: str,
               small_int_bits: int | None = None) -> DataFrame:
    """G-mode: per key the most frequent non-NULL value (smallest on ties),
    its count and the number of distinct values:
    ``{prefix}_mode, {prefix}_mode_count, {prefix}_nunique``.

    With ``small_int_bits`` (values are integers in [0, 2**bits), e.g. hours)
    count and value are packed in one long and the fold is a hash-based
    ``max``; otherwise it is ``min(struct(-count, value))``."""
    v = F.col(value) if isinstance(value, str) else value
    counts = (df.filter(F.col(key).isNotNull()).select(F.col(key), v.alias("_v"))
              .filter(F.col("_v").isNotNull()).groupBy(key, "_v").agg(F.count(F.lit(1)).alias("_n")))
    if small_int_bits is not None:
        b = small_int_bits
        best = counts.groupBy(key).agg(
            F.max(F.col("_n") * F.lit(1 << b) + (F.lit((1 << b) - 1) - F.col("_v").cast("long"))).alias("_p"),
            F.count("_v").alias(f"{prefix}_nunique"))
        return best.select(key, (F.lit((1 << b) - 1) - F.pmod(F.col("_p"), F.lit(1 << b))).cast("int")
                           .alias(f"{prefix}_mode"),
                           F.shiftrightunsigned(F.col("_p"), b).alias(f"{prefix}_mode_count"), f"{prefix}_nunique")
    best = counts.groupBy(key).agg(
        F.min(F.struct((-F.col("_n")).alias("neg_n"), F.col("_v").alias("v"))).alias("_m"),
        F.count("_v").alias(f"{prefix}_nunique"))
    return best.select(key, F.col("_m.v").alias(f"{prefix}_mode"),
                       (-F.col("_m.neg_n")).alias(f"{prefix}_mode_count"), f"{prefix}_nunique")


def value_counts(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """G-vc: per combination of ``keys`` (none NULL) the count of non-NULL
    ``measure`` and its sum (0 when all are NULL)."""
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df.filter(cond).groupBy(*keys).agg(F.count(measure).alias("count"), zero_sum(measure).alias("sum"))


def two_level(df: DataFrame, key: str, inner: str, measure: str, prefix: str) -> DataFrame:
    """G-2lvl: count and sum of ``measure`` per (key, inner), then mean,
    median and max of each per key (``{prefix}_count_mean`` ...).

    The median of counts keeps a buffer of distinct counts (small); the
    median of sums, which can take as many values as the key has inner
    values, goes through the distributed rank path."""
    vc = materialize(value_counts(df, [key, inner], measure))      # read twice
    agg = vc.groupBy(key).agg(
        F.avg("count").alias(f"{prefix}_count_mean"), F.median("count").alias(f"{prefix}_count_median"),
        F.max("count").alias(f"{prefix}_count_max"), F.avg("sum").alias(f"{prefix}_sum_mean"),
        F.max("sum").alias(f"{prefix}_sum_max"))
    med = exact_quantiles(vc, "sum", [0.5], by=[key]).select(key, F.col("q").alias(f"{prefix}_sum_median"))
    return agg.join(med, key, "left")
