"""Counts per employee and day beside a stream, and trailing sums that move with the time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.operators.daily import DAY, daily_counts, edge_counts, moved, part_column, whole_days
from movewell.streaming.folders import exists, finished, remove
from movewell.streaming.published import LATEST, PublishedTable

DAILY = "employee_id BIGINT, day DATE, n BIGINT, batch BIGINT, part DATE"
TOTALS = "employee_id BIGINT, nb_activites BIGINT"


class TrailingCounts:
    """Activities of the last days, kept up with a stream of activities and with the time.

    ``days/batch=B/part=D`` holds what a batch counted by day, and counts add up over batches; a part is a day or a
    month of days (``unit``), which bronze is partitioned by, too. ``totals``
    holds the sums over the whole days of the period, of which a step rewrites the employees concerned: days that enter and
    leave and rows that came late. History is not read again. A replayed batch overwrites its own counts.
    """

    def __init__(self, spark: SparkSession, path: str, unit: str = DAY):
        self.spark, self.path, self.unit = spark, path.rstrip("/"), unit
        self.totals = PublishedTable(spark, f"{self.path}/totals", newest=LATEST)

    def forget(self) -> None:
        """Start anew, for a stream that starts anew."""
        if exists(self.spark, self.path):
            remove(self.spark, self.path)

    def add(self, activities: DataFrame, batch_id: int) -> None:
        """Count a batch by day. Parts of very uneven size are dealt to files of even size."""
        counts = daily_counts(activities).withColumn("part", part_column(self.unit, "day")).hint("rebalance", "part")
        counts.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/days/batch={batch_id}")

    def daily(self) -> DataFrame:
        """employee_id, day, n, batch and part of all finished batches; the last two are partitions."""
        done = finished(self.spark, f"{self.path}/days/batch=*")
        rows = self.spark.read.schema(DAILY).parquet(f"{self.path}/days")
        return rows.where(F.col("batch") <= max(done))

    def _reached(self) -> tuple[int, datetime | None]:
        """Batch and time that the totals stand at."""
        versions = self.totals.versions()
        if not versions:
            return -1, None
        newest = [f"{self.totals.path}/changes/version={versions[-1]}/batch={b}" for b in self.totals.batches()]
        for folder in [*reversed(newest), f"{self.totals.path}/version={versions[-1]}"]:  # a step without rows moved nothing
            row = self.spark.read.parquet(folder).select("batch_id", "as_of").first()
            if row:
                return row["batch_id"], datetime.fromisoformat(row["as_of"])
        return -1, None

    def advance(self, batch_id: int, as_of: datetime, days: int) -> None:
        """Move the totals to the days before ``as_of`` and the batches up to ``batch_id``."""
        seen, stood = self._reached()
        steps = moved(self.daily(), whole_days(stood, days) if stood else None, seen, whole_days(as_of, days), self.unit)
        marks = {"as_of": as_of.isoformat()}
        if stood is None:
            self.totals.publish(steps.withColumnRenamed("n", "nb_activites"), batch_id, **marks)
        else:
            sums = self.totals.read().join(steps, "employee_id", "right").select(
                "employee_id", (F.coalesce("nb_activites", F.lit(0)) + F.col("n")).alias("nb_activites"))
            self.totals.publish_changes(sums, batch_id, **marks)

    def counts(self, activities: DataFrame, as_of: datetime, days: int) -> DataFrame:
        """employee_id and nb_activites of the period, exact to the moment; the two cut days come from ``activities``."""
        whole = self.totals.read().withColumnRenamed("nb_activites", "n")
        both = whole.unionByName(edge_counts(activities, as_of, days, self.unit))
        return both.groupBy("employee_id").agg(F.sum("n").alias("nb_activites")).where("nb_activites > 0")
