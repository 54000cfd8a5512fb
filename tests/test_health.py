import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from movewell.functions.time import moment
from movewell.operators import health

START = datetime(2025, 1, 1)


def brute_force_increase(samples, seconds):
    totals, counts, last = defaultdict(float), defaultdict(int), {}
    for series, ts, tie, value in sorted(samples):
        previous = last.get(series)
        grown = 0 if previous is None else value if value < previous else value - previous
        window = START + timedelta(seconds=(ts - START).total_seconds() // seconds * seconds)
        totals[series, window] += grown
        counts[series, window] += 1
        last[series] = value
    return {key: (totals[key], counts[key]) for key in totals}


def sample_rows(rows, series, same_time):
    source = random.Random(rows)
    made = []
    for number in range(rows):
        name = "hot" if source.random() < 0.5 else f"s{source.randrange(series)}"
        moment = START + timedelta(seconds=60 if source.random() < same_time else source.randrange(4000))
        made.append((name, moment, number, float(source.randrange(1000))))
    return made


@pytest.mark.parametrize("rows, series, same_time", [(1, 1, 0), (400, 3, 0), (3000, 40, 0.4)])
def test_increase_equals_brute_force(spark, rows, series, same_time):
    made = sample_rows(rows, series, same_time)
    frame = spark.createDataFrame(made, "series string, ts timestamp_ntz, event_id bigint, value double")
    result = health.counter_increase(frame.repartition(6), "300 seconds", ["series"])
    ours = {(r["series"], r["window_start"]): (r["increase"], r["samples"]) for r in result.collect()}
    assert ours == brute_force_increase(made, 300)


def test_increase_does_not_depend_on_the_partitions(spark):
    made = sample_rows(2000, 5, 0.5)
    frame = spark.createDataFrame(made, "series string, ts timestamp_ntz, event_id bigint, value double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    results = []
    try:
        for width in ("1", "3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            rows = health.counter_increase(frame, "300 seconds", ["series"]).collect()
            results.append({(r["series"], r["window_start"]): r["increase"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert results[0] == results[1] == results[2]


def test_rate_adds_the_series_of_an_application(spark):
    rows = [("gold", "a", START, 1, 10.0), ("gold", "a", START + timedelta(seconds=30), 2, 40.0),
            ("gold", "b", START, 3, 5.0), ("gold", "b", START + timedelta(seconds=50), 4, 35.0)]
    frame = spark.createDataFrame(rows, "app string, series string, ts timestamp_ntz, event_id int, value double")
    assert [tuple(r) for r in health.counter_rate(frame, 60, "app", ["series"]).collect()] == [("gold", START, 1.0)]


def test_liveness(spark):
    rows = [("bronze", START), ("gold", START - timedelta(seconds=60)), ("gold", START - timedelta(seconds=90)),
            ("other", START)]
    frame = spark.createDataFrame(rows, "stream string, ts timestamp_ntz")
    up = health.stream_liveness(frame, START + timedelta(seconds=30), "60 seconds", streams="bronze|gold")
    assert {r["stream"]: r["up"] for r in up.collect()} == {"bronze": 1, "gold": 0}


def test_batch_rate(spark):
    rows = [("a", START + timedelta(seconds=s), "spark_batches") for s in (0, 10, 59, 60)] + [("a", START, "cpu")]
    frame = spark.createDataFrame(rows, "app string, ts timestamp_ntz, metric string")
    rates = health.batch_rate(frame, 60, name="metric", names="spark_.*").orderBy("window_start").collect()
    assert [(r["events"], r["per_second"]) for r in rates] == [(3, 0.05), (1, 1 / 60)]


def test_lag(spark):
    def message(arrived_ms, source):
        return 1, bytearray(json.dumps({"payload": {"op": "c", **source}}), "utf-8"), START + timedelta(milliseconds=arrived_ms)

    start_ms = 1_735_689_600_000  # START in UTC
    rows = [message(1500, {"source": {"ts_ms": start_ms}}), message(1600, {"source": {"ts_ms": start_ms + 700}}), message(5000, {})]
    frame = spark.createDataFrame(rows, "stream int, value binary, timestamp timestamp_ntz").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    lags = health.cdc_lag(health.arrival_samples(frame, "stream"), "1 minute", "stream").collect()
    assert [tuple(r)[2:] for r in lags] == [(900, 1500)]


def test_sessions(spark):
    rows = [("active", "activities", "Connector 1"), ("idle", "activities", "Connector 2"), ("idle", "activities", "Connector"),
            ("idle", "activities", "my Connector"), ("idle", "postgres", "Connector 3"), ("idle", "activities", None)]
    frame = spark.createDataFrame(rows, "state string, datname string, application_name string")
    counts = {r["state"]: r["sessions"] for r in health.sessions_by_state(frame, "activities", "Connector.*").collect()}
    assert counts == {"active": 1, "idle": 2}


def test_hot_series_is_cut_into_even_runs(spark):
    frame = spark.range(0, 40_000).select(
        F.lit("only").alias("series"), moment(START).alias("ts"), F.col("id").alias("event_id"),
        F.col("id").cast("double").alias("value"))
    plan = health.counter_increase(frame, "1 hour", ["series"])
    assert [tuple(r) for r in plan.collect()] == [("only", START, 39_999.0, 40_000)]
    runs = frame.repartitionByRange("series", "ts", "event_id").groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in runs.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 40_000 / 4


def test_the_last_of_equal_arrivals_is_the_one_furthest_behind(spark):
    from movewell.operators.health import cdc_lag
    rows = [("2024-01-01 00:00:00", "2024-01-01 00:00:05"), ("2024-01-01 00:00:03", "2024-01-01 00:00:05"), ("2024-01-01 00:00:00", "2024-01-01 00:00:04")]
    frame = spark.createDataFrame(rows, "committed string, arrived string").select(
        *[F.col(c).cast("timestamp").alias(c) for c in ("committed", "arrived")])
    assert [r["last_lag_ms"] for r in cdc_lag(frame, "1 hour").collect()] == [5000]
