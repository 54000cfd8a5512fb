"""Synthetic activities: a year per employee, repeatable for a seed, without a shuffle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.fixed_values import (
    ACTIVITY_TYPES,
    GENERATED_DAYS,
    GENERATED_METRES,
    GENERATED_PER_EMPLOYEE,
    GENERATED_SECONDS,
    MARKER_COMMENT,
    MARKER_EMPLOYEE_ID,
    MARKER_TYPE,
    PROBE_COMMENT,
    PROBE_EMPLOYEE_ID,
)
from movewell.functions.time import moment
from movewell.schemas import LOADED_ACTIVITY


def _draw(digest: Column, piece: int, lowest: int, highest: int) -> Column:
    """A number in [lowest, highest] from one of the four 32-bit pieces of an md5 text."""
    number = F.conv(F.substring(digest, 8 * piece + 1, 8), 16, 10).cast("bigint")
    return F.lit(lowest) + number % F.lit(highest - lowest + 1)


def generate_activities(ids: DataFrame, as_of: datetime, seed: int = 0) -> DataFrame:
    """Activities of the year before ``as_of`` for each employee id.

    Every value is a hash of (seed, employee, number), so neither the partitioning nor a
    repeated task changes the result.
    """
    def digest(*parts: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *(part.cast("string") for part in parts)))

    employee = F.col("employee_id").cast("bigint")
    quantity = _draw(digest(employee), 0, *GENERATED_PER_EMPLOYEE)
    numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), quantity))
    numbered = ids.select(employee.alias("employee_id"), numbers.alias("_no"))
    hashed = numbered.select("employee_id", digest(F.col("employee_id"), F.col("_no")).alias("_digest"))
    drawn = F.col("_digest")
    days_back = _draw(drawn, 0, 0, GENERATED_DAYS - 1)
    kinds = F.array(*(F.lit(kind) for kind in ACTIVITY_TYPES))
    centimetres = _draw(drawn, 2, *(100 * bound for bound in GENERATED_METRES))
    activities = hashed.select(
        "employee_id",
        (moment(as_of) - F.make_dt_interval(days_back.cast("int"))).alias("date_debut"),
        F.get(kinds, _draw(drawn, 1, 0, len(ACTIVITY_TYPES) - 1).cast("int")).alias("type_activite"),
        (centimetres / F.lit(100.0)).alias("distance_m"),
        _draw(drawn, 3, *GENERATED_SECONDS).cast("int").alias("duree_s"))
    comment = F.format_string("Session de %s de %s m, durée %d s.", "type_activite",
                              F.col("distance_m").cast("string"), "duree_s")
    return activities.withColumn("commentaire", comment)


def _one_row(spark: SparkSession, *values) -> DataFrame:
    return spark.createDataFrame([values], LOADED_ACTIVITY)


def backfill_marker(spark: SparkSession, as_of: datetime) -> DataFrame:
    """The row that ends a back-fill; append it after the activities."""
    return _one_row(spark, MARKER_EMPLOYEE_ID, as_of, MARKER_TYPE, 0.0, 0, MARKER_COMMENT)


def probe_activity(spark: SparkSession, as_of: datetime) -> DataFrame:
    """One activity of an employee HR does not know, to see a change travel the pipeline."""
    return _one_row(spark, PROBE_EMPLOYEE_ID, as_of, ACTIVITY_TYPES[0], 5000.0, 1800, PROBE_COMMENT)
