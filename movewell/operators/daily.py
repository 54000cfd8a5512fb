"""Activities per employee and day, and trailing periods as sums of days."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewell.functions.time import moment


DAY, MONTH = "day", "month"  # how finely tables are partitioned by time


def part_column(unit: str, when: str = "date_debut_ts") -> Column:
    """The first day of the partition a time belongs to."""
    if unit not in (DAY, MONTH):
        raise ValueError(f"tables are partitioned by {DAY} or {MONTH}, not {unit}")
    return F.trunc(day_of(when), MONTH) if unit == MONTH else day_of(when)


def day_of(when: str = "date_debut_ts") -> Column:
    return F.to_date(F.col(when).cast("timestamp_ntz"))


def daily_counts(activities: DataFrame, when: str = "date_debut_ts") -> DataFrame:
    """employee_id, day and n; rows without an employee or a time count nowhere. Counted in each task first."""
    known = activities.where(F.col("employee_id").isNotNull() & F.col(when).isNotNull())
    return (known.groupBy(F.col("employee_id").cast("bigint").alias("employee_id"), day_of(when).alias("day"))
            .agg(F.count(F.lit(1)).alias("n")))


def whole_days(as_of: datetime, days: int) -> tuple[date, date]:
    """First and last of the days that lie wholly within the ``days`` up to ``as_of``; none if the first is later."""
    return (as_of - timedelta(days=days)).date() + timedelta(days=1), as_of.date() - timedelta(days=1)


Days = tuple[date, date]  # first and last


def _minus(one: Days, other: Days | None) -> list[Days]:
    """The days of one period that are not in the other."""
    if other is None or one[0] > one[1] or other[0] > other[1]:
        return [one]
    day = timedelta(days=1)
    return [(one[0], min(one[1], other[0] - day)), (max(one[0], other[1] + day), one[1])]


def part_of(day: date, unit: str) -> date:
    return day.replace(day=1) if unit == MONTH else day


def _among(periods: list[Days], unit: str) -> Column:
    """Rows of these days, by their partition first."""
    within = [F.col("part").between(F.lit(part_of(a, unit)), F.lit(part_of(b, unit))) & F.col("day").between(F.lit(a), F.lit(b))
              for a, b in periods if a <= b]
    return reduce(or_, within, F.lit(False))


def moved(daily: DataFrame, before: Days | None, seen: int, after: Days, unit: str = DAY) -> DataFrame:
    """employee_id and n, by which sums over the days ``before`` become sums over the days ``after``.

    daily: employee_id, day, n, and as partitions of the table part and batch. Days that enter are added, days that
    leave are taken off as far as batches up to ``seen`` had brought them in, and later batches of the days that
    stay are added. Days that stay are not read again.
    """
    enters = _among(_minus(after, before), unit)
    leaves = _among(_minus(before, after) if before else [], unit) & (F.col("batch") <= seen)
    late = _among([(max(after[0], before[0]), min(after[1], before[1]))] if before else [], unit) & (F.col("batch") > seen)
    touched = daily.where(enters | leaves | late)
    return touched.groupBy("employee_id").agg(F.sum(F.when(leaves, -F.col("n")).otherwise(F.col("n"))).alias("n"))


def edge_counts(activities: DataFrame, as_of: datetime, days: int, unit: str = DAY, when: str = "date_debut_ts") -> DataFrame:
    """employee_id and n of the two days that the period cuts; activities are partitioned by ``part``."""
    start = as_of - timedelta(days=days)
    parts = [part_of(cut.date(), unit) for cut in (start, as_of)]
    edges = activities.where(F.col("part").isin(parts) & F.col("employee_id").isNotNull())
    inside = F.col(when).cast("timestamp_ntz").between(moment(start), moment(as_of)) & day_of(when).isin(start.date(), as_of.date())
    return edges.where(inside).groupBy(F.col("employee_id").cast("bigint").alias("employee_id")).agg(F.count(F.lit(1)).alias("n"))
