"""Data quality load by load: only what is new is evaluated, the counts of all loads add up."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.operators.quality import Suite, dq_by_part, dq_merged
from movewell.streaming.folders import exists

COUNTS = ("part STRING, rows_read BIGINT, rows_checked BIGINT, rule_no INT, unexpected_count BIGINT, at TIMESTAMP, suite STRING")


class LoadStatistics:
    """Counts of every rule for every part (a load, a day) of a table that grows by parts.

    A part is evaluated once under a suite, its bounds included; under another suite it is evaluated anew. A part
    that rows were added to is named in ``again``.
    """

    def __init__(self, spark: SparkSession, path: str, suite: Suite):
        self.spark, self.path, self.suite = spark, path.rstrip("/"), suite
        self.fingerprint = hashlib.md5(repr(suite).encode()).hexdigest()

    def _counts(self) -> DataFrame:
        rows = (self.spark.read.schema(COUNTS).parquet(self.path) if exists(self.spark, self.path)
                else self.spark.createDataFrame([], COUNTS))
        own = rows.where(F.col("suite") == self.fingerprint)
        newest = own.groupBy("part").agg(F.max("at").alias("at"))
        return own.join(newest, ["part", "at"], "left_semi")

    def missing(self, rows: DataFrame, part: str = "part") -> list[str]:
        """Parts not evaluated yet; no column of the table but the partition is read."""
        known = {row["part"] for row in self._counts().select("part").distinct().collect()}
        return sorted({row[0] for row in rows.select(F.col(part).cast("string")).distinct().collect()} - known - {None})

    def evaluate(self, rows: DataFrame, references: Mapping[str, DataFrame], part: str = "part", again: list[str] = []) -> list[str]:
        """Evaluate the parts that are new and those named; return them. Others are not scanned."""
        parts = sorted({*self.missing(rows, part), *again})
        if parts:
            wanted = rows.where(F.col(part).isin([F.lit(p).cast(rows.schema[part].dataType) for p in parts]))
            counts = dq_by_part(wanted, self.suite, references, part).withColumn(part, F.col(part).cast("string")).withColumnRenamed(part, "part")
            counts.select("*", F.current_timestamp().alias("at"), F.lit(self.fingerprint).alias("suite")).coalesce(1).write.mode(
                "append").partitionBy("suite").parquet(self.path)
        return parts

    def statistics(self) -> DataFrame:
        return dq_merged(self._counts(), self.suite)
