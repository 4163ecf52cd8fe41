"""One-scan, two-level aggregation per key.

Per-phone features mix plain aggregates (count, mean), distinct counts
under conditions, modes, medians and aggregates of aggregates (calls per
contact, calls per day).  Written as separate ``groupBy``s and joins each
would re-read the log.  Here one ``GROUPING SETS`` aggregation (Spark's
``Expand``, whole-stage code-generated) groups every row by (key) and by
(key, value) for each *grain* (contact, hour, handset ...), with map-side
combine, and a second aggregation folds those groups into one row per key.
A hot key is spread by its values in the first shuffle and reaches the
second pre-aggregated.

The groups of a log are several times its rows, so moving them twice costs
far more than moving the rows once.  In a log of more than ``SMALL_LOG``
rows, counted first, keys of at most ``HOT_ROWS`` rows are therefore dealt
to tasks whole, as rows, and both aggregations run where the rows lie; only
the rows of hotter keys go by groups.  A key that large is never held in one
place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonelens.functions.joins import join_bounded

GRAIN = "_grain"
ROW = "row"
# Rows of a log that is not worth dealing by key.
SMALL_LOG = 200_000
# Rows dealt to one task: its groups, some six times as many, stay well within its memory.
TASK_ROWS = 200_000
# Rows of a key that one task may hold.
HOT_ROWS = 20_000


def grain_value(name: str) -> str:
    return f"_v_{name}"


def is_grain(name: str) -> Column:
    """Level-2 predicate: the level-1 row is a group of grain ``name``
    (for a value grain, only groups of a non-NULL value)."""
    if name == ROW:
        return F.col(GRAIN) == F.lit(ROW)
    return (F.col(GRAIN) == F.lit(name)) & F.col(grain_value(name)).isNotNull()


def deal_by_key(df: DataFrame, key: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows partitioned by ``key``, rows to be spread by other columns): a
    key's rows are all in one of the two, either of which may be missing.
    The key must not be NULL."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows, most = per_key.agg(F.sum("_n"), F.max("_n")).first()            # two numbers
    if (rows or 0) <= SMALL_LOG:
        return None, df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    if most <= HOT_ROWS:
        return df.repartition(tasks, key), None
    hot = per_key.filter(F.col("_n") > HOT_ROWS).select(key)
    dealt = join_bounded(df, hot, [key], "left_anti").repartition(tasks, key)
    return dealt, join_bounded(df, hot, [key], "left_semi")


def _by_groups(df: DataFrame, key: str, grains: dict[str, Column], level1: list[Column]) -> DataFrame:
    """Level 1 by ``GROUPING SETS``: a shuffle by (key, value)."""
    names = list(grains)
    vcols = [grain_value(n) for n in names]
    base = df.select("*", *[grains[n].alias(v) for n, v in zip(names, vcols)])
    sets = [[key]] + [[key, v] for v in vcols]
    flags = [F.grouping(v).alias(f"_gg{i}") for i, v in enumerate(vcols)]
    first = base.groupingSets(sets, key, *vcols).agg(F.count(F.lit(1)).alias("_n"), *level1, *flags)
    grain = F.coalesce(*[F.when(F.col(f"_gg{i}") == 0, F.lit(n)) for i, n in enumerate(names)], F.lit(ROW))
    return first.withColumn(GRAIN, grain)


def _in_place(df: DataFrame, key: str, grains: dict[str, Column], level1: list[Column]) -> DataFrame:
    """Level 1 over rows partitioned by key, which ``explode`` keeps (an
    ``Expand`` would not): no shuffle."""
    names = list(grains)
    vcols = [grain_value(n) for n in names]
    at = F.explode(F.array(*[F.lit(i) for i in range(len(names) + 1)]))   # the last one is the row grain
    base = df.select("*", at.alias("_at"))
    base = base.select("*", *[F.when(F.col("_at") == i, grains[n]).alias(grain_value(n)) for i, n in enumerate(names)])
    first = base.groupBy(key, "_at", *vcols).agg(F.count(F.lit(1)).alias("_n"), *level1)
    return first.withColumn(GRAIN, F.get(F.array(*[F.lit(n) for n in [*names, ROW]]), F.col("_at")))


def fan_out_aggregate(
    df: DataFrame,
    key: str,
    grains: dict[str, Column],
    level1: list[Column],
    level2: list[Column],
    inside: tuple[dict[str, Column], list[Column]] | None = None,
    beside: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Aggregate ``df`` per ``key`` through grains.

    grains: name -> value column; NULL values are ignored by the grain, so
        a conditional grain is ``F.when(cond, value)``.  The grain ``row``
        (one group per key) always exists.
    level1: aggregates per group over the raw rows (plain columns only).
    level2: aggregates per key over the level-1 groups; select a grain with
        ``is_grain`` and read its value from ``grain_value(name)``.
    inside, beside: the same further columns in two ways: more grains and
        level-2 aggregates, whose buffers may hold all values of a key, for
        keys that one task may hold; for the others, a function from their rows to
        one row per key.
    """
    dealt, spread = deal_by_key(df.filter(F.col(key).isNotNull()), key)
    parts = []
    if dealt is not None:
        more_grains, more = inside or ({}, [])
        parts.append(_in_place(dealt, key, {**grains, **more_grains}, level1).groupBy(key).agg(*level2, *more))
    if spread is not None:
        out = _by_groups(spread, key, grains, level1).groupBy(key).agg(*level2)
        parts.append(out if beside is None else out.join(beside(spread), key, "left"))
    return reduce(DataFrame.unionByName, parts)
