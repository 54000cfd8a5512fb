"""Folders that Spark's writer has finished, found by the mark it leaves, and their removal."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished(spark: SparkSession, pattern: str) -> dict[int, datetime]:
    """Number and time (UTC) of the folders ``pattern``, such as ``/lake/version=*``, whose write has ended."""
    path, files = _path(spark, f"{pattern}/_SUCCESS")
    marks = files.globStatus(path) or []
    return {int(mark.getPath().getParent().getName().split("=")[1]):
            datetime.fromtimestamp(mark.getModificationTime() / 1000, timezone.utc) for mark in marks}


def exists(spark: SparkSession, pattern: str) -> bool:
    path, files = _path(spark, pattern)
    return bool(files.globStatus(path))


def remove(spark: SparkSession, folder: str) -> None:
    path, files = _path(spark, folder)
    files.delete(path, True)
