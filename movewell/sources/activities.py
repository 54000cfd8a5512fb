"""Activity table: batch reads for validation, bronze as batch or stream, bulk load."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from movewell.schemas import BRONZE, CHANGES, LOADED_ACTIVITY


def jdbc_options(url: str, table: str, lowest_id: int, highest_id: int, tasks: int) -> dict[str, str]:
    """Options that split a database read into id ranges, one query per task."""
    return {
        "url": url, "dbtable": table, "fetchsize": "10000", "partitionColumn": "id",
        "lowerBound": str(lowest_id), "upperBound": str(highest_id), "numPartitions": str(tasks),
    }


def read_activities(spark: SparkSession, source: str | Mapping[str, str]) -> DataFrame:
    """The activity table: a parquet folder, or a database through jdbc_options()."""
    if isinstance(source, str):
        return spark.read.parquet(source)
    return spark.read.format("jdbc").options(**source).load()


IN_PARTS = T.StructType([*BRONZE.fields, T.StructField("part", T.DateType())])


def read_bronze(spark: SparkSession, path: str, fmt: str = "parquet", in_parts: bool = False) -> DataFrame:
    """Bronze as a table; ``in_parts`` if it was written by time, with its partitions as a column ``part``."""
    return spark.read.format(fmt).schema(IN_PARTS if in_parts else BRONZE).load(path)


def read_changes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(CHANGES).load(path)


def stream_bronze(spark: SparkSession, path: str, fmt: str = "parquet", in_parts: bool = False, **options: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(IN_PARTS if in_parts else BRONZE).options(**options).load(path)


TEXT_LAYOUT = {"sep": "\t", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def append_activities(activities: DataFrame, target: str | Mapping[str, str]) -> None:
    """Bulk load, added to what is there: tab-separated text without header, or a database table."""
    writer = activities.select(*LOADED_ACTIVITY.names).write.mode("append")
    if isinstance(target, str):
        writer.options(**TEXT_LAYOUT).csv(target)
    else:
        writer.format("jdbc").options(**target).save()


def read_loaded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOADED_ACTIVITY).options(**TEXT_LAYOUT).csv(path)
