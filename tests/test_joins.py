"""The left join to one row per key: rows, plans and balance."""

import pytest
from pyspark.sql import functions as F

from movewell.operators.joins import left_join_unique


def skewed_rows(spark):
    """30 000 rows in 12 tasks: a third under key 7, a third under null, a third spread."""
    number = F.col("id")
    key = F.when(number % 3 == 0, F.lit(7)).when(number % 3 == 1, F.lit(None)).otherwise(number % 500)
    return spark.range(0, 30_000, 1, 12).select(number.alias("row_id"), key.cast("bigint").alias("k"))


def lookup_table(spark):
    return spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))


def final_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_every_row_once_with_its_value(spark, no_broadcast):
    rows = left_join_unique(skewed_rows(spark), lookup_table(spark), "k").collect()
    assert len({row["row_id"] for row in rows}) == len(rows) == 30_000
    assert all(row["v"] == (row["k"] * 10 if row["k"] is not None and row["k"] < 400 else None) for row in rows)


def test_small_lookup_is_joined_without_moving_rows(spark):
    plan = final_plan(left_join_unique(skewed_rows(spark), lookup_table(spark), "k"))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_hot_and_null_keys_are_split_at_run_time(spark, no_broadcast):
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = left_join_unique(skewed_rows(spark), lookup_table(spark), "k")
        sizes = joined.select(F.spark_partition_id().alias("p")).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    counts = {}
    for row in sizes:
        counts[row["p"]] = counts.get(row["p"], 0) + 1
    assert sum(counts.values()) == 30_000 and max(counts.values()) < 15_000  # unsplit, 22 000 rows meet in one task


@pytest.mark.parametrize("rows", [0, 1])
def test_tiny_inputs(spark, no_broadcast, rows):
    frame = spark.range(rows).select(F.col("id").alias("k"), F.lit("x").alias("x"))
    assert left_join_unique(frame, lookup_table(spark), "k").count() == rows
