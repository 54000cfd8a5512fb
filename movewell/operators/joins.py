"""Left joins to a lookup with one row per key, and counts per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows per non-null key; each task sends one row per key, and only the key is read."""
    return (rows.select(key).where(F.col(key).isNotNull())
            .groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")))


def left_join_unique(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows LEFT JOIN lookup USING (key)`` where lookup has one row per key.

    One plan for all sizes, left to Spark: a lookup within its broadcast limit moves no rows, a
    larger one is joined by shuffle, where partitions made large by a hot or a null key are split
    at run time, as the rows stand on the outer side. The lookup must be one whose size Spark can
    tell: a stream's state is not, it looks as small as the batch's new rows.
    """
    return rows.join(lookup, key, "left")
