"""Health that is kept up: heartbeats, rates and increases as streams, counts of what could not be decoded."""

import glob
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from movewell.operators import health
from movewell.plans import queries, views
from movewell.sources.cdc import decode_envelope, decode_with_problem, read_cdc_stream
from movewell.streaming import rates as kept_up
from movewell.streaming.bronze import start_bronze, start_quarantine
from movewell.streaming.progress import ProgressLog, batches, read_progress
from movewell.streaming.runs import finish

START = datetime(2025, 1, 1)


@pytest.fixture
def log(spark, tmp_path):
    made = ProgressLog(spark, f"{tmp_path}/progress", pace=0.5)
    spark.streams.addListener(made)
    yield made
    spark.streams.removeListener(made)
    made.close()


def liveness(spark, path, as_of, threshold):
    rows = read_progress(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return {r["stream"]: r["up"] for r in health.stream_liveness(rows, as_of, threshold).collect()}


def last_row(spark, path, stream):
    return read_progress(spark, path).where(F.col("stream") == stream).agg(F.max("ts").cast("timestamp_ntz")).first()[0]


def test_running_and_idle_streams_are_alive_and_a_stopped_one_is_not(spark, tables, tmp_path, log):
    views.cdc_messages(spark, tables).write.parquet(f"{tmp_path}/log")
    messages = read_cdc_stream(spark, "parquet", {"path": f"{tmp_path}/log"})
    log.wait_for(finish(start_bronze(messages, f"{tmp_path}/b", f"{tmp_path}/ck-b")))
    idle = start_quarantine(messages, f"{tmp_path}/q", f"{tmp_path}/ck-q", every="100 milliseconds")
    busy = spark.readStream.format("rate").load().writeStream.queryName("busy").foreachBatch(
        lambda _rows, batch: time.sleep(6 if batch > 1 else 0)).start()  # a batch so long that no report comes
    try:
        time.sleep(9)
        now = max(last_row(spark, log.path, "quarantine"), last_row(spark, log.path, "busy"))
        assert liveness(spark, log.path, now, "3 seconds") == {"bronze": 0, "quarantine": 1, "busy": 1}
    finally:
        idle.stop()
        busy.stop()
    assert batches(read_progress(spark, log.path)).where("stream = 'bronze'").count() >= 1
    assert read_progress(spark, log.path).where("batch_id IS NULL AND input_rows <> 0").isEmpty()


def test_reports_of_a_failed_write_are_written_later(spark, tables, tmp_path):
    path = tmp_path / "taken"
    path.write_text("a file where the table should be")
    log = ProgressLog(spark, str(path), pace=1000)
    spark.streams.addListener(log)
    try:
        views.cdc_messages(spark, tables).write.parquet(f"{tmp_path}/log")
        log.wait_for(finish(start_bronze(read_cdc_stream(spark, "parquet", {"path": f"{tmp_path}/log"}), f"{tmp_path}/b", f"{tmp_path}/ck")))
        log.path = f"{tmp_path}/progress"
        log.flush()
    finally:
        spark.streams.removeListener(log)
        log.close()
    assert batches(read_progress(spark, log.path)).agg(F.sum("input_rows")).first()[0] == 1500


def test_problems_are_told_apart(spark, tables):
    messages = views.damaged_messages(spark, tables)
    judged = decode_with_problem(messages, "offset")
    found = {(r["way"], r["problem"]) for r in judged.select((F.col("offset") % 8).alias("way"), "problem").distinct().collect()}
    assert found == {(0, "unreadable"), (1, "empty"), (2, "empty"), (3, "unreadable"), (4, "empty"), (5, "empty"), (6, "unreadable"), (7, None)}
    plain = decode_envelope(messages, "offset")
    assert judged.drop("problem").exceptAll(plain).isEmpty() and plain.count() == judged.count()


def test_counts_of_a_damaged_log_and_its_quarantine(spark, tables, tmp_path, log):
    """Over two runs: every message is counted once, and unreadable ones are kept as they came."""
    for part in (0, 1):
        views.damaged_messages(spark, tables).where(F.col("offset") % 2 == part).write.mode("append").parquet(f"{tmp_path}/log")
        messages = read_cdc_stream(spark, "parquet", {"path": f"{tmp_path}/log"})
        log.wait_for(finish(start_bronze(messages, f"{tmp_path}/b", f"{tmp_path}/ck-b")))
        finish(start_quarantine(messages, f"{tmp_path}/q", f"{tmp_path}/ck-q"))
    sums = batches(read_progress(spark, log.path)).where("stream = 'bronze'").agg(F.sum("input_rows"), F.sum("unreadable"), F.sum("empty")).first()
    damaged = views.damaged_messages(spark, tables).where("offset % 8 IN (0, 3, 6)")
    kept = spark.read.parquet(f"{tmp_path}/q")
    empty = views.damaged_messages(spark, tables).where("offset % 8 IN (1, 2, 4, 5)").count()
    assert tuple(sums) == (1500, damaged.count(), empty) and kept.count() == damaged.count()
    assert kept.drop("problem").exceptAll(damaged.select("partition", "offset", "value")).isEmpty()


@pytest.mark.parametrize("query", ["stream_progress", "unreadable_messages"])
def test_every_core_has_a_file_of_each_batch(spark, tables, query, monkeypatch, tmp_path):
    """Four batches whatever the number of cores; a batch of one file was read by one task."""
    monkeypatch.setattr(queries, "shared_dir", lambda spark, purpose: f"{tmp_path}/{purpose}")
    queries.REGISTRY[query](spark, tables).collect()
    cores, taken = spark.sparkContext.defaultParallelism, []
    for batch in glob.glob(f"{tmp_path}/*/checkpoint*/sources/0/[0-9]*"):
        with open(batch) as file:
            taken.append(sum(line.startswith("{") for line in file))
    assert taken == [cores] * 4 * (len(glob.glob(f"{tmp_path}/*/checkpoint*")))
    assert cores > 1 and taken


def samples(spark, rows):
    return spark.createDataFrame(rows, "app string, ts timestamp, n long")


def test_rates_of_a_stream_equal_the_batch_with_late_rows(spark, tmp_path):
    """Rows come up to four minutes late, over restarts; a window is written once, and open ones are counted too."""
    rows = [("ab"[n % 2], START + timedelta(seconds=n * 7 - (240 if n % 5 == 0 else 0)), n) for n in range(400)]
    for low in range(0, 400, 100):
        samples(spark, rows[low:low + 100]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema("app string, ts timestamp, n long").parquet(f"{tmp_path}/in")
        finish(kept_up.start_rates(arriving, f"{tmp_path}/closed", f"{tmp_path}/ck", 60, "5 minutes"))
    closed, everything = spark.read.parquet(f"{tmp_path}/closed"), spark.read.parquet(f"{tmp_path}/in")
    expected = {tuple(r) for r in health.batch_rate(everything, 60).collect()}
    found = [tuple(r) for r in kept_up.rates_now(closed, everything, 60).collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert 0 < closed.count() < len(expected)
    assert kept_up.rates_now(closed.limit(0), everything, 60).count() == len(expected)


COUNTER = "series string, ts timestamp_ntz, event_id bigint, value double"


def counter(rows=600):
    made = []
    for n in range(rows):
        series = "hot" if n % 3 else f"s{n % 7}"
        made.append((series, START + timedelta(seconds=n // 4 * 11), n, float((n * 37) % 500)))  # drops, and equal times
    return made


def test_an_increase_kept_up_equals_the_batch(spark, tmp_path):
    """Five batches with a restart for each, a failure between steps and carried samples, and a replayed batch."""
    rows = counter()
    log = kept_up.IncreaseLog(spark, f"{tmp_path}/log", "300 seconds", ["series"])
    for batch, low in enumerate(range(0, 600, 120)):
        spark.createDataFrame(rows[low:low + 120], COUNTER).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(COUNTER).parquet(f"{tmp_path}/in")
        if batch == 2:
            real, log.carried.publish_changes = log.carried.publish_changes, lambda *_, **__: 1 / 0
            with pytest.raises(StreamingQueryException):
                finish(log.start(arriving, f"{tmp_path}/ck"))
            log.carried.publish_changes = real
        finish(log.start(arriving, f"{tmp_path}/ck"))
    log.on_batch(spark.createDataFrame(rows[480:], COUNTER), log.carried.batches()[-1])
    whole = health.counter_increase(spark.createDataFrame(rows, COUNTER), "300 seconds", ["series"])
    expected = {(r["series"], r["window_start"]): (r["increase"], r["samples"]) for r in whole.collect()}
    assert {(r["series"], r["window_start"]): (r["increase"], r["samples"]) for r in log.read().collect()} == expected


def test_new_samples_move_once(spark, no_broadcast):
    new = spark.createDataFrame(counter(50), COUNTER)
    carried = spark.createDataFrame([("hot", (START, 1, 2.0))], "series string, last struct<at: timestamp_ntz, tie: bigint, value: double>")
    plan = health.increase_after(new, "300 seconds", ["series"], carried)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2  # the samples by series and window; then one row of each by series
    assert sum("window_start" in line for line in exchanges) == 1


def test_only_changed_series_are_carried_anew(spark, tmp_path):
    log = kept_up.IncreaseLog(spark, f"{tmp_path}/log", "300 seconds", ["series"])
    log.on_batch(spark.createDataFrame([(f"s{n}", START, n, 1.0) for n in range(500)], COUNTER), 0)
    log.on_batch(spark.createDataFrame([("s7", START + timedelta(seconds=9), 501, 4.0)], COUNTER), 1)
    assert spark.read.parquet(f"{log.carried.path}/changes/version=0/batch=1").count() == 1
    assert {r["increase"] for r in log.read().where("series = 's7'").collect()} == {3.0}


def test_no_samples(spark, tmp_path):
    log = kept_up.IncreaseLog(spark, f"{tmp_path}/log", "300 seconds", ["series"])
    none = spark.createDataFrame([], COUNTER)
    log.on_batch(none, 0)
    log.on_batch(spark.createDataFrame(counter(10), COUNTER), 1)
    assert log.read().agg(F.sum("samples")).first()[0] == 10
