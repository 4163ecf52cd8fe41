from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonelens.functions.grain import ROW, grain_value, is_grain

KEY = "phone_no_m"
CONTACT = "opposite_no_m"


def row_val(name: str) -> Column:
    """Level-2 access to an aggregate of the ``row`` grain."""
    return F.max(F.when(is_grain(ROW), F.col(name)))


def n_values(grain: str) -> Column:
    """Distinct non-NULL values of a grain (its number of level-1 groups)."""
    return F.count_if(is_grain(grain))


def n_values_if(grain: str, cond: Column) -> Column:
    """Distinct values of a grain whose level-1 group meets ``cond`` (e.g.
    contacts the phone called: the contact group has a caller row)."""
    return F.count_if(is_grain(grain) & cond)


def over_grain(agg, grain: str, col: str) -> Column:
    """An aggregate of a level-1 column over the groups of one grain."""
    return agg(F.when(is_grain(grain), F.col(col)))


def grain_median(grain: str) -> Column:
    """Exact median of a grain's value over the raw rows; its buffer holds
    the key's distinct values."""
    return F.percentile(F.when(is_grain(grain), F.col(grain_value(grain))), F.lit(0.5), F.col("_n"))


# Hours (0-23) and days of month (1-31) fit in 6 bits.
SMALL_INT_BITS = 6


def grain_mode_packed(grain: str, bits: int = SMALL_INT_BITS) -> Column:
    """Mode of a grain whose values are integers in [0, 2**bits): the
    count and the value packed in one long, ``count·2^bits + (2^bits-1-v)``,
    so the largest packed number is the highest count with the smallest
    value.  A plain ``max`` keeps the aggregation hash-based (a struct
    minimum would force a sort-based one)."""
    top = (1 << bits) - 1
    v = F.col(grain_value(grain)).cast("long")
    return F.max(F.when(is_grain(grain), F.col("_n") * F.lit(1 << bits) + (F.lit(top) - v)))


def packed_mode_value(col: str, bits: int = SMALL_INT_BITS) -> Column:
    return (F.lit((1 << bits) - 1) - F.pmod(F.col(col), F.lit(1 << bits))).cast("int")


def packed_mode_count(col: str, bits: int = SMALL_INT_BITS) -> Column:
    return F.shiftrightunsigned(F.col(col), bits)


def when_any(flag: str, value: Column) -> Column:
    """value where a level-2 count ``flag`` is positive, else NULL (pandas
    left-joined a sub-table that had no row for the key)."""
    return F.when(F.col(flag) > 0, value)
