"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension that may be broadcast, and bytes that the optimizer's own
#: estimate may come to where it is an upper bound.
MOST_ROWS, MOST_BYTES = 100_000, 4 << 20
#: What can make more rows than the estimate says; of Parquet files it is their
#: compressed size, which says little of the rows.
_GROWING = ("Generate", "Join", "MapIn", "FlatMap", "Python", "Range", "parquet")


def is_small(df: DataFrame, most: int = MOST_ROWS) -> bool:
    """Whether df has at most that many rows: by the size of what it reads, where
    nothing multiplies rows, else by counting up to one row beyond. The count runs
    while a plan is built, as a job of its own that stops at that row."""
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    if not any(word in text for word in _GROWING) and int(str(plan.stats().sizeInBytes())) <= MOST_BYTES:
        return True
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df marked for broadcast if it is small, else df as it is, for Spark to join
    as it sees fit."""
    return F.broadcast(df) if is_small(df, most) else df


def large(df: DataFrame) -> DataFrame:
    """df, which grows with the world, marked for a join by shuffle. Spark takes the
    compressed size of a stored table for its size, which is a twentieth of what its
    rows take as a broadcast, and would send millions of them through the driver."""
    return df.hint("merge")
