"""Scalar and aggregate expression helpers (all built-in, JVM-side).

NULL, a sum over only NULLs is 0, rounding follows numpy (half to even).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """A / b, NULL when b is 0 or either side is NULL."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def ratio_or_null(a: Column | str, b: Column | str) -> Column:
    """a / b where a count of 0 means "no matching row": NULL, not 0."""
    return safe_ratio(F.nullif(_c(a), F.lit(0)), b)


def np_round(x: Column | str, digits: int = 4) -> Column:
    """Numpy-style round (scale, round half to even, unscale)."""
    scale = float(10 ** digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)


def sig_round(x: Column | str, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (half to even).

    Used to compare doubles whose last bits depend on summation order.
    Infinite and near-denormal values stay as they are."""
    x = _c(x)
    apart = (F.abs(x) == float("inf")) | (F.abs(x) < 1e-290)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x.isNull() | (x == 0) | F.isnan(x) | apart, x).otherwise(F.rint(x * scale) / scale)


# Doubles are first snapped to 14 significant digits, which absorbs the
# last-bit differences of summation order (relative 1e-16 .. 1e-15), then
# rounded to the compared 10 digits.  A single rounding would split values
# that lie exactly on a 10-digit boundary, such as a mean of cents over 8 rows.
SNAP_DIGITS = 14


def stable(df: DataFrame, digits: int = 10) -> DataFrame:
    """Round every double column to ``digits`` significant digits (after
    snapping to ``SNAP_DIGITS``), for value-by-value comparison."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            snapped = sig_round(F.col(f.name).cast("double"), SNAP_DIGITS)
            cols.append(sig_round(snapped, digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def zero_sum(x: Column | str) -> Column:
    """G-sum: sum where a group of only NULLs gives 0, as pandas does."""
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def nan_text(c: Column | str) -> Column:
    """Cast to text with NULL spelled "nan"."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan"))


def parse_datetime(text: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text -> timestamp without zone; unparsable text gives NULL."""
    return F.try_to_timestamp(_c(text), F.lit(fmt)).cast("timestamp_ntz")


def month_of(ts: Column | str) -> Column:
    """Month of the year."""
    return F.month(_c(ts))


def hour_of(ts: Column | str) -> Column:
    return F.hour(_c(ts))


def day_of(ts: Column | str) -> Column:
    """Day of the month (not the date)."""
    return F.dayofmonth(_c(ts))


def date_of(ts: Column | str) -> Column:
    """The date part of a timestamp."""
    return F.to_date(_c(ts))


def time_of(ts: Column | str) -> Column:
    """The time part as text."""
    return F.date_format(_c(ts), "HH:mm:ss")
