"""Orderings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def activities_by_date(activities: DataFrame, when: str = "date_debut", tie: str = "id") -> DataFrame:
    """Activities by start time over the whole table.

    The unique id breaks ties, which makes the order total and lets the range partitioning
    split a day that holds a large share of the rows.
    """
    return activities.orderBy(when, tie)
