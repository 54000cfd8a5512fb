"""The table that a change log describes: updates replace a row, deletes take it away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELETE = "d"


def current_rows(changes: DataFrame, key: str = "id", order: str = "offset", op: str = "op") -> DataFrame:
    """The last row of each key in order of offset, without keys whose last change is a delete.

    All changes of a key lie in one partition of the topic, where offsets tell their order. A change without
    a key or an operation changes nothing. Each task sends one row per key, however often it changed.
    """
    others = [name for name in changes.columns if name != key]
    last = (changes.where(F.col(key).isNotNull() & F.col(op).isNotNull()).groupBy(key)
            .agg(F.max_by(F.struct(*others), order).alias("_last")))
    return last.where(F.col(f"_last.{op}") != DELETE).select(key, "_last.*").select(*changes.columns)
