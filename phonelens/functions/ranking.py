"""Exact ranks and quantiles without a single-task window.

``row_number() over (partition by label order by ...)`` puts a whole class
in one task.  Here the rows are range-partitioned and sorted by (group,
order) across all tasks, each task numbers its own rows, and a small table
of per-(task, group) counts turns local numbers into global ranks (a large
group, such as a phone with a third of all rows, spans many tasks).  The
sorted data is checkpointed to the session's checkpoint folder so the
numbering and the counts read the very same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonelens.functions.joins import join_bounded
from phonelens.session import materialize

# Offsets table rows = partitions x groups; broadcast it only below this.
MAX_BROADCAST_OFFSETS = 200_000
# Rows of one block of running sums (a divisor of 2**33, the id step between tasks).
BLOCK_ROWS = 256
# Distinct values of a group whose quantiles are taken in one buffer.
SMALL_GROUP = 10_000
# Rows of a table (a value and a weight each) that one task may sort.
SMALL_TABLE = 100_000


def ranked(df: DataFrame, by: list[str], order: list[Column], rank_col: str = "_rank") -> DataFrame:
    """Add a 0-based ``rank_col`` within each ``by`` group following
    ``order`` (ties get distinct, arbitrary-but-fixed ranks).

    ``by`` may have any cardinality: the offsets table has one row per
    (task, group) present in that task — about groups + tasks rows, since a
    group spans several tasks only when it is large.  It is broadcast when
    small (classes, column names) and joined by shuffle otherwise (phones).
    Group keys must not be NULL.  The range sort reads ``df`` twice (bounds
    sample, then sort): materialize an expensive input first."""
    srt = materialize(df.orderBy(*[F.col(c) for c in by], *order)
                      .withColumn("_pid", F.spark_partition_id())
                      .withColumn("_mid", F.monotonically_increasing_id()))
    counts = srt.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", *by, "_first",
                            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    out = join_bounded(srt, offsets, ["_pid", *by], max_rows=MAX_BROADCAST_OFFSETS)
    return out.withColumn(rank_col, F.col("_off") + F.col("_mid") - F.col("_first")).drop(
        "_pid", "_mid", "_first", "_off")


def cumulative(df: DataFrame, by: list[str], order: str, weight: str, small: int | None = None) -> DataFrame:
    """Add ``_start`` (weights of the group's rows before this one) and
    ``_total`` (the group's weight) to rows that are distinct on (by, order).

    Distinct values sort apart, so a value that a third of all rows share
    is one light row, and a group with many values spans many tasks.  Sums
    run on three levels: rows of a block of neighbours, blocks of a task of the
    sort, tasks of a group; the last has a row per task, whatever the rows.
    A table of at most ``small`` (default SMALL_TABLE) rows, counted first, is one task's work and takes one
    window.  Group keys must not be NULL; without any, all rows are one group."""
    small = SMALL_TABLE if small is None else small
    if not by:
        return cumulative(df.withColumn("_all", F.lit(0)), ["_all"], order, weight, small).drop("_all")

    def before(of: str, within: list[str], at: str) -> Column:
        w = Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(of).over(w), F.lit(0))

    df = materialize(df)
    if df.count() <= small:
        return df.withColumn("_start", before(weight, by, order)).withColumn("_total", F.sum(weight).over(Window.partitionBy(*by)))
    block = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)
    srt = materialize(df.orderBy(*[F.col(c) for c in by], F.col(order)).withColumn("_pid", F.spark_partition_id())
                      .withColumn("_blk", block))
    blocks = materialize(srt.groupBy("_pid", "_blk", *by).agg(F.sum(weight).alias("_cnt")))
    tasks = blocks.groupBy("_pid", *by).agg(F.sum("_cnt").alias("_task"))
    tasks = tasks.select("_pid", *by, before("_task", by, "_pid").alias("_before"), F.sum("_task").over(Window.partitionBy(*by)).alias("_total"))
    offsets = blocks.withColumn("_inside", before("_cnt", ["_pid", *by], "_blk")).join(tasks, ["_pid", *by]).select(
        "_blk", *by, (F.col("_before") + F.col("_inside")).alias("_off"), "_total")
    run = srt.withColumn("_run", before(weight, ["_blk", *by], order)).drop("_pid")
    out = join_bounded(run, offsets, ["_blk", *by], max_rows=MAX_BROADCAST_OFFSETS)
    return out.withColumn("_start", F.col("_off") + F.col("_run")).drop("_blk", "_run", "_off")


def quantiles_at(r: DataFrame, value: str, weight: str, probs: list[float], by: list[str]) -> DataFrame:
    """Linear-interpolation quantiles from rows that ``cumulative`` has
    numbered: ``*by, prob, q``.

    Position ``p·(n-1)`` lies between two order statistics; a row knows from
    its start and weight which positions it holds, so all others are filtered before
    the last grouping, which sees two rows per (group, prob)."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    pos = lambda p: (F.col("_total") - 1).cast("double") * p
    holds = lambda at: (F.col("_start") <= at) & (at < F.col("_start") + F.col(weight))
    mine = F.filter(wanted, lambda p: holds(F.floor(pos(p))) | holds(F.ceil(pos(p))))
    rows = r.withColumn("_mine", mine).filter(F.size("_mine") > 0).select("*", F.explode("_mine").alias("prob"))
    p = pos(F.col("prob"))
    ends = rows.groupBy(*by, "prob").agg(
        F.max(F.when(holds(F.floor(p)), F.col(value))).alias("_xlo"),
        F.max(F.when(holds(F.ceil(p)), F.col(value))).alias("_xhi"), F.max(p - F.floor(p)).alias("_frac"))
    q = F.when(F.col("_frac") == 0, F.col("_xlo")).otherwise(
        F.col("_xlo") + (F.col("_xhi") - F.col("_xlo")) * F.col("_frac"))
    return ends.select(*by, "prob", q.alias("q"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    small: int | None = None, weight: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (numpy ``percentile`` / SQL
    ``quantile_cont``) of ``value`` per ``by`` group, one row per
    (group, prob): columns ``*by, prob, q``.

    Rows are first counted per distinct value.  A group of at most ``small``
    (default SMALL_GROUP) distinct values is one bounded buffer (Spark's exact ``percentile`` over values and
    counts); only larger groups are sorted over all tasks.  Both ways are
    exact.  Group keys must not be NULL.  With ``weight``, rows are distinct
    on (by, value) and that column holds their counts."""
    by = by or []
    small = SMALL_GROUP if small is None else small
    base = df.filter(F.col(value).isNotNull())
    x = F.col(value).cast("double").alias("_x")
    if weight is None:
        counted = materialize(base.select(*by, x).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_w")))
    else:
        counted = base.select(*by, x, F.col(weight).alias("_w"))
    large = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > small).drop("_n")
    few, many = counted, None
    if not by:
        if counted.count() > small:
            few, many = None, counted
    else:
        large = materialize(large)
        if not large.isEmpty():
            many, few = join_bounded(counted, large, by, "left_semi"), join_bounded(counted, large, by, "left_anti")
    out = None
    if few is not None:
        at = F.array(*[F.lit(float(p)) for p in probs])
        q = few.groupBy(*by).agg(F.percentile("_x", at, F.col("_w")).alias("_q")).select(*by, F.posexplode("_q").alias("_i", "q"))
        out = q.filter(F.col("q").isNotNull()).select(*by, F.get(at, F.col("_i")).alias("prob"), "q")
    if many is not None:
        # groups this large are spread over tasks, however few rows there are in all
        run = cumulative(many, by, "_x", "_w", small=0 if by else None)
        sorted_way = quantiles_at(run, "_x", "_w", probs, by)
        out = sorted_way if out is None else out.unionByName(sorted_way)
    return out
