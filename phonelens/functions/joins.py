"""Joins against a side whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonelens.session import materialize

# Rows of a small side that may be broadcast to every task.
MAX_BROADCAST_ROWS = 200_000


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner",
                 max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with ``small`` (few join-key values, e.g. one row per
    fold, class or measure).  ``small`` is written once and counted; it is
    broadcast only when it has at most ``max_rows`` rows, otherwise the
    join is left to Spark's shuffle strategies.  A low-cardinality key in a
    shuffle join would send each key's share of ``big`` to one task."""
    small = materialize(small)
    if small.count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)
