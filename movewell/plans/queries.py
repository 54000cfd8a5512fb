"""The registered queries: each takes (spark, folder of the given tables)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.fixed_values import GOLD_VIEW, HR_ADDRESS, HR_MODE, RATE_STEPS
from movewell.functions import status
from movewell.functions.time import moment
from movewell.operators import distances, eligibility, health, kpi, notifications as notices, quality
from movewell.operators.changes import current_rows
from movewell.operators.daily import MONTH, part_column
from movewell.operators.generator import backfill_marker, generate_activities, probe_activity
from movewell.operators.ordering import activities_by_date as ordered_by_date
from movewell.plans import views
from movewell.rules import DEFAULT, load_rules
from movewell.session import shared_dir
from movewell.sources.activities import append_activities, read_activities, read_bronze, read_changes, read_loaded
from movewell.sources.cdc import decode_activities, decode_changes, read_cdc_stream
from movewell.sources.hr import hr_ids, load_hr, strip_headers, write_hr
from movewell.sources.routes import parse_distances
from movewell.streaming.bronze import start_bronze, start_changes, start_quarantine
from movewell.streaming.daily import TrailingCounts
from movewell.streaming.folded import FoldedTable, by_part
from movewell.streaming.gold import INCREMENTAL, REBUILD, GoldJob
from movewell.streaming.loads import LoadStatistics
from movewell.streaming.notify import Outbox
from movewell.streaming.progress import ProgressLog, batches, read_progress
from movewell.streaming.published import PublishedTable
from movewell.streaming.rates import IncreaseLog, rates_now, start_rates
from movewell.streaming.runs import finish

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
WAVES = 3


def registered(query: Query) -> Query:
    """Add the query under its name. Times are UTC whatever the session's default."""
    @wraps(query)
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf_dir)

    REGISTRY[query.__name__] = in_utc
    return in_utc


# --- HR, bonus and gold -------------------------------------------------------------------


@registered
def hr_reference(spark, sf_dir):
    return load_hr(views.hr_sheet(spark, sf_dir))


@registered
def commute_bonus(spark, sf_dir):
    return eligibility.commute_bonus(views.hr(spark, sf_dir), DEFAULT)


@registered
def wellness_days(spark, sf_dir):
    return eligibility.wellness_days(views.kept_activities(spark, sf_dir), DEFAULT)


@registered
def wellness_trailing(spark, sf_dir):
    recent = eligibility.trailing(
        views.kept_activities(spark, sf_dir), views.AS_OF, DEFAULT.window_days, "date_debut")
    return eligibility.wellness_days(recent, DEFAULT)


@registered
def gold_eligibility(spark, sf_dir):
    return eligibility.gold_eligibility(views.hr(spark, sf_dir), views.kept_activities(spark, sf_dir), DEFAULT)


@registered
def gold_sparse(spark, sf_dir):
    """Gold where most employees have no activity: events count by user."""
    active = views.events(spark, sf_dir).select(F.col("user_id").alias("employee_id"))
    return eligibility.gold_eligibility(views.hr(spark, sf_dir), active, DEFAULT)


def _publish_gold(spark: SparkSession, sf_dir: str) -> None:
    gold = PublishedTable(spark, shared_dir(spark, "gold"))
    gold.publish(gold_eligibility(spark, sf_dir), fingerprint="default")
    gold.register(GOLD_VIEW)


@registered
def gold_sql_kpi(spark, sf_dir):
    _publish_gold(spark, sf_dir)
    return kpi.kpi_by_unit(spark)


@registered
def gold_sql_total(spark, sf_dir):
    _publish_gold(spark, sf_dir)
    return kpi.kpi_total(spark)


# --- Change records and streams -----------------------------------------------------------


def _zoneless(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn("date_debut_ts", F.col("date_debut_ts").cast("timestamp_ntz"))


@registered
def cdc_decode(spark, sf_dir):
    return _zoneless(decode_activities(views.cdc_messages(spark, sf_dir)))


@registered
def cdc_decode_damaged(spark, sf_dir):
    return _zoneless(decode_activities(views.damaged_messages(spark, sf_dir)))


def _arriving(spark: SparkSession, sf_dir: str, log: str, messages: DataFrame | None = None) -> Iterator[DataFrame]:
    """Write the whole change log (or other messages over the same offsets) in offset order, a third at a time; yield the stream after each.

    Running the same query after each part makes it resume from its checkpoint.
    """
    messages = messages or views.cdc_messages(spark, sf_dir)
    top = views.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    for wave in range(WAVES):
        low, high = wave * (top + 1) // WAVES, (wave + 1) * (top + 1) // WAVES
        part = messages.where((F.col("offset") >= low) & (F.col("offset") < high))
        part.write.mode("append").parquet(log)
        yield read_cdc_stream(spark, "parquet", {"path": log})


@registered
def bronze_stream(spark, sf_dir):
    base = shared_dir(spark, "bronze")
    for messages in _arriving(spark, sf_dir, f"{base}/log"):
        finish(start_bronze(messages, f"{base}/table", f"{base}/checkpoint"))
    return _zoneless(read_bronze(spark, f"{base}/table"))


def _stream_gold(spark: SparkSession, sf_dir: str, mode: str, rules=lambda wave: (DEFAULT, "default"), as_of=None) -> GoldJob:
    """Run bronze and gold over the arriving log; each wave restarts both, under the wave's rules and time."""
    base, now = shared_dir(spark, "gold-stream"), {"wave": 0}
    job = GoldJob(f"{base}/bronze", views.hr(spark, sf_dir), lambda: rules(now["wave"]), PublishedTable(spark, f"{base}/gold"),
                  mode, as_of=as_of and (lambda: as_of(now["wave"])), by=MONTH)
    for now["wave"], messages in enumerate(_arriving(spark, sf_dir, f"{base}/log")):
        finish(start_bronze(messages, job.bronze_path, f"{base}/bronze-checkpoint", by=MONTH if as_of else None))
        finish(job.start(f"{base}/gold-checkpoint", every=None))
    return job


@registered
def gold_stream(spark, sf_dir):
    return _stream_gold(spark, sf_dir, INCREMENTAL).gold.read()


@registered
def gold_trailing_stream(spark, sf_dir):
    """Gold over the trailing days, which move from wave to wave and end at the last order."""
    return _stream_gold(spark, sf_dir, INCREMENTAL, as_of=lambda wave: views.AS_OF - timedelta(days=40 * (WAVES - 1 - wave))).gold.read()


@registered
def wellness_daily(spark, sf_dir):
    """The trailing count from days: activities are counted by day as they arrive, and the period moves twice."""
    base = shared_dir(spark, "daily")
    rows = views.kept_activities(spark, sf_dir).withColumn("part", part_column(MONTH, "date_debut"))
    rows.withColumnRenamed("date_debut", "date_debut_ts").hint("rebalance", "part").write.partitionBy("part").parquet(f"{base}/activities")
    written = spark.read.parquet(f"{base}/activities")
    trail = TrailingCounts(spark, f"{base}/trailing", MONTH)
    for batch, behind in enumerate((400, 30, 0)):
        trail.add(written.where(F.pmod("id", F.lit(WAVES)) == batch), batch)
        trail.advance(batch, views.AS_OF - timedelta(days=behind), DEFAULT.window_days)
    return eligibility.with_wellness_flag(trail.counts(written, views.AS_OF, DEFAULT.window_days), DEFAULT)


@registered
def gold_stream_sql(spark, sf_dir):
    """Indicators that SQL finds under gold's name while the stream runs: each version is registered."""
    _stream_gold(spark, sf_dir, INCREMENTAL)
    return kpi.kpi_by_unit(spark)


RULES_FILES = ('{"prime_sportive": {"percent": 0.05}, "bien_etre": {"min_activities": 15}, '
               '"distance": {"max_walk_km": 15, "max_bike_km": 25}}',
               '{"prime_sportive": {"percent": 0.08}, "bien_etre": {"min_activities": 12}, '
               '"distance": {"max_walk_km": 10, "max_bike_km": 20}}')


@registered
def gold_stream_rules(spark, sf_dir):
    """Gold under a rules file that changes between two restarts, with the file's fingerprint."""
    base = shared_dir(spark, "rules")
    for number, text in enumerate(RULES_FILES):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{number}.json")
    job = _stream_gold(spark, sf_dir, INCREMENTAL, lambda wave: load_rules(f"{base}/{min(wave, 1)}.json", spark))
    return job.gold.read().withColumn("fingerprint", F.lit(job.gold.latest()["fingerprint"]))


@registered
def gold_stream_rebuild(spark, sf_dir):
    return _stream_gold(spark, sf_dir, REBUILD).gold.read()


@registered
def notifications(spark, sf_dir):
    messages = views.cdc_messages(spark, sf_dir)
    gates = notices.barriers(notices.creations(notices.may_hold_marker(messages)))
    return notices.notifications(notices.creations(messages), gates)


@registered
def notifications_stream(spark, sf_dir):
    base = shared_dir(spark, "notify")
    outbox = Outbox(spark, f"{base}/outbox")
    for messages in _arriving(spark, sf_dir, f"{base}/log"):
        finish(outbox.start(messages, f"{base}/checkpoint"))
    return outbox.read().drop("batch")


@registered
def notifications_topic(spark, sf_dir):
    """Three partitions, of which two open at their own marker and one never does; no search once all known are open."""
    base = shared_dir(spark, "notify-topic")
    outbox = Outbox(spark, f"{base}/outbox", partitions=3)
    for messages in _arriving(spark, sf_dir, f"{base}/log", views.topic_messages(spark, sf_dir)):
        finish(outbox.start(messages, f"{base}/checkpoint"))
    return outbox.read().drop("batch")


@registered
def notifications_folded(spark, sf_dir):
    """The texts of a stream whose small files are folded and removed while it goes on."""
    base = shared_dir(spark, "notify-folded")
    outbox = Outbox(spark, f"{base}/outbox")
    for messages in _arriving(spark, sf_dir, f"{base}/log"):
        finish(outbox.start(messages, f"{base}/checkpoint"))
        outbox.fold()
        outbox.clean_up(timedelta(0), datetime.now(timezone.utc) + timedelta(minutes=1))
    return outbox.read().drop("batch")


@registered
def bronze_folded(spark, sf_dir):
    """Bronze by month: months that are closed are folded after each part of the log, the others read as they came."""
    base = shared_dir(spark, "bronze-folded")
    folded = FoldedTable(spark, f"{base}/folded", by_part())
    for number, messages in enumerate(_arriving(spark, sf_dir, f"{base}/log")):
        finish(start_bronze(messages, f"{base}/bronze", f"{base}/checkpoint", by=MONTH))
        if number == WAVES - 1:  # orders come in no order of time: only now is a month closed
            folded.fold(read_bronze(spark, f"{base}/bronze", in_parts=True), 19971231)
            folded.fold(read_bronze(spark, f"{base}/bronze", in_parts=True), 20001231)
    return _zoneless(folded.read(read_bronze(spark, f"{base}/bronze", in_parts=True)).drop("part"))


# --- Updates and deletes applied ------------------------------------------------------------


@registered
def current_activities(spark, sf_dir):
    """The activities that are left once every change of the log is applied."""
    rows = current_rows(decode_changes(views.change_messages(spark, sf_dir)))
    return _zoneless(rows).drop("partition")


@registered
def gold_current_stream(spark, sf_dir):
    """Gold over activities as they stand, from a log whose updates and deletes arrive in three parts."""
    base = shared_dir(spark, "changes")
    for messages in _arriving(spark, sf_dir, f"{base}/log", views.change_messages(spark, sf_dir)):
        finish(start_changes(messages, f"{base}/changes", f"{base}/checkpoint"))
    return eligibility.gold_eligibility(views.hr(spark, sf_dir), current_rows(read_changes(spark, f"{base}/changes")), DEFAULT)


# --- Data quality -------------------------------------------------------------------------


def _quality_inputs(spark, sf_dir):
    suite = quality.with_date_bounds(quality.without_column(quality.ACTIVITY_SUITE, "commentaire"), views.AS_OF)
    references = {"employee_id": hr_ids(views.customer_ids(spark, sf_dir))}
    return views.activities(spark, sf_dir), suite, references


@registered
def dq_statistics(spark, sf_dir):
    return quality.dq_statistics(*_quality_inputs(spark, sf_dir))


@registered
def dq_table(spark, sf_dir):
    """Statistics over an activity table that was written and is read as a source."""
    rows, suite, references = _quality_inputs(spark, sf_dir)
    path = f"{shared_dir(spark, 'activities')}/table"
    rows.write.parquet(path)
    return quality.dq_statistics(read_activities(spark, path), suite, references)


@registered
def dq_loads(spark, sf_dir):
    """Statistics of a table that came in three loads, of which each was evaluated alone."""
    rows, suite, references = _quality_inputs(spark, sf_dir)
    base = shared_dir(spark, "loads")
    counts = LoadStatistics(spark, f"{base}/counts", suite)
    for load in range(WAVES):
        rows.where(F.pmod("id", F.lit(WAVES)) == load).write.parquet(f"{base}/table/load={load}")
        counts.evaluate(spark.read.parquet(f"{base}/table"), references, "load")
    return counts.statistics()


@registered
def dq_summary(spark, sf_dir):
    return quality.dq_summary(quality.dq_statistics(*_quality_inputs(spark, sf_dir)))


@registered
def dq_violations(spark, sf_dir):
    return quality.dq_violations(*_quality_inputs(spark, sf_dir))


@registered
def invalid_employee_ids(spark, sf_dir):
    rows, _, references = _quality_inputs(spark, sf_dir)
    return quality.invalid_employee_ids(rows, references["employee_id"])


# --- Distances and declarations -----------------------------------------------------------


@registered
def distance_parse(spark, sf_dir):
    return parse_distances(views.route_responses(spark, sf_dir))


@registered
def distinct_addresses(spark, sf_dir):
    return distances.distinct_addresses(views.hr_people(spark, sf_dir))


def _enriched(spark, sf_dir):
    people = views.hr_people(spark, sf_dir)
    return distances.distance_enrich(people, parse_distances(views.route_responses(spark, sf_dir)))


@registered
def distance_enrich(spark, sf_dir):
    return _enriched(spark, sf_dir)


@registered
def declaration_check(spark, sf_dir):
    return distances.declaration_check(views.hr(spark, sf_dir), DEFAULT)


@registered
def hr_writeback(spark, sf_dir):
    """The untidy sheet, enriched with distances and checked, written to a folder and read back."""
    sheet = strip_headers(views.hr_sheet(spark, sf_dir))
    resolved = parse_distances(views.route_responses(spark, sf_dir)).withColumnRenamed("address", HR_ADDRESS)
    enriched = distances.distance_enrich(sheet, resolved, HR_ADDRESS)
    checked = distances.declaration_check(enriched.withColumnRenamed(HR_MODE, "moyen_dep"), DEFAULT)
    path = f"{shared_dir(spark, 'hr')}/enriched"
    write_hr(checked, path)
    return spark.read.parquet(path)


# --- Ordering and generated data ----------------------------------------------------------


@registered
def activities_by_date(spark, sf_dir):
    return ordered_by_date(views.activities(spark, sf_dir))


def _generated(spark, sf_dir):
    rows = generate_activities(views.customer_ids(spark, sf_dir), views.AS_OF, seed=42)
    return rows.unionByName(probe_activity(spark, views.AS_OF)).unionByName(backfill_marker(spark, views.AS_OF))


@registered
def activity_generator(spark, sf_dir):
    return _generated(spark, sf_dir)


@registered
def activity_load(spark, sf_dir):
    """Generated activities bulk-loaded as text files, marker last, and read back."""
    path = f"{shared_dir(spark, 'load')}/activities"
    append_activities(generate_activities(views.customer_ids(spark, sf_dir), views.AS_OF, seed=42), path)
    append_activities(probe_activity(spark, views.AS_OF), path)
    append_activities(backfill_marker(spark, views.AS_OF), path)
    return read_loaded(spark, path)


# --- Stream health ------------------------------------------------------------------------


BATCHES = 4


def _in_batches(spark: SparkSession, messages: DataFrame, log: str) -> DataFrame:
    """Write all messages; give the stream that takes a quarter of them in a batch, of which every core reads a file."""
    cores = spark.sparkContext.defaultParallelism
    messages.repartition(BATCHES * cores).write.parquet(log)
    return read_cdc_stream(spark, "parquet", {"path": log, "maxFilesPerTrigger": str(cores)})


@registered
def stream_progress(spark, sf_dir):
    """Rows and batches of a stream over all messages, from the table its listener writes."""
    base = shared_dir(spark, "progress")
    messages = _in_batches(spark, views.cdc_messages(spark, sf_dir), f"{base}/log")
    log = ProgressLog(spark, f"{base}/progress", piece=3)
    spark.streams.addListener(log)
    try:
        log.wait_for(finish(start_bronze(messages, f"{base}/table", f"{base}/checkpoint")))
    finally:
        spark.streams.removeListener(log)
        log.close()
    rows = read_progress(spark, f"{base}/progress").where("input_rows > 0")
    return rows.groupBy("stream").agg(F.count(F.lit(1)).alias("batches"), F.sum("input_rows").alias("input_rows"))


@registered
def unreadable_messages(spark, sf_dir):
    """Messages of a damaged log: counted by the stream that decodes them, and the unreadable ones kept."""
    base = shared_dir(spark, "unreadable")
    messages = _in_batches(spark, views.damaged_messages(spark, sf_dir), f"{base}/log")
    log = ProgressLog(spark, f"{base}/progress")
    spark.streams.addListener(log)
    try:
        for begin, table in ((start_bronze, "bronze"), (start_quarantine, "quarantine")):
            log.wait_for(finish(begin(messages, f"{base}/{table}", f"{base}/checkpoint-{table}")))
    finally:
        spark.streams.removeListener(log)
        log.close()
    kept = spark.read.parquet(f"{base}/quarantine").agg(F.count(F.lit(1)).alias("kept"), F.max("offset").alias("last_kept"))
    counts = batches(read_progress(spark, f"{base}/progress")).where("stream = 'bronze'")
    sums = counts.agg(*[F.sum(c).alias(c) for c in ("input_rows", "unreadable", "empty")])
    return sums.select("*", kept.select("kept").scalar().alias("kept"), kept.select("last_kept").scalar().alias("last_kept"))


@registered
def stream_heartbeats(spark, sf_dir):
    """A stream that ended and one that lives on without new messages, told apart by the table of their reports."""
    base, idle = shared_dir(spark, "heartbeats"), "spark.sql.streaming.noDataProgressEventInterval"
    views.cdc_messages(spark, sf_dir).write.parquet(f"{base}/log")
    messages = read_cdc_stream(spark, "parquet", {"path": f"{base}/log"})
    log = ProgressLog(spark, f"{base}/progress", pace=0.5)
    spark.streams.addListener(log)
    spark.conf.set(idle, "500ms")
    try:
        log.wait_for(finish(start_bronze(messages, f"{base}/bronze", f"{base}/checkpoint")))
        ended = read_progress(spark, f"{base}/progress").agg(F.max("ts")).first()[0]
        living = start_quarantine(messages, f"{base}/quarantine", f"{base}/checkpoint-quarantine", every="200 milliseconds")
        heard = ended
        for _ in range(120):
            time.sleep(0.5)
            rows = read_progress(spark, f"{base}/progress")
            heard = rows.where("stream = 'quarantine' AND batch_id IS NULL").agg(F.max("ts")).first()[0] or ended
            if heard > ended + timedelta(seconds=5) and not batches(rows).where("stream = 'quarantine'").isEmpty():
                break
        living.stop()
    finally:
        spark.conf.unset(idle)
        spark.streams.removeListener(log)
        log.close()
    rows = read_progress(spark, f"{base}/progress")
    up = health.stream_liveness(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")), heard, "4 seconds").drop("last_seen")
    return up.join(batches(rows).groupBy("stream").agg(F.sum("input_rows").alias("input_rows")), "stream")


@registered
def stream_liveness(spark, sf_dir):
    samples = views.events(spark, sf_dir).withColumn("stream", F.col("user_id").cast("string"))
    return health.stream_liveness(samples, views.EVENTS_AS_OF, "12 hours", streams="[0-9]+")


def _rates(spark, sf_dir):
    samples = views.events(spark, sf_dir).select(
        (F.col("user_id") % 2).alias("app"), "ts", status.spark_metric_name(F.col("event_type")).alias("metric"))
    return health.batch_rate(samples, 3600, name="metric", names="spark_.*")


@registered
def batch_rate(spark, sf_dir):
    return _rates(spark, sf_dir)


def _in_waves(spark: SparkSession, rows: DataFrame, wave: Column, base: str) -> Iterator[str]:
    """Write rows by the number of their wave to one folder; yield it after each."""
    for number in range(WAVES):
        rows.where(wave == number).write.mode("append").parquet(f"{base}/samples")
        yield f"{base}/samples"


def _wave_of(when: Column) -> Column:
    """Thirds of the events' month by the time given."""
    day = F.timestamp_diff("DAY", moment(datetime(2024, 1, 1)), when)
    return F.least(F.lit(WAVES - 1), F.greatest(F.lit(0), F.floor(day / 10).cast("int")))


@registered
def batch_rate_stream(spark, sf_dir):
    """The batch rates, kept up as a stream over samples of which many come up to two hours late."""
    base, rates = shared_dir(spark, "rates"), dict(name="metric", names="spark_.*")
    samples = views.events(spark, sf_dir).select(
        (F.col("user_id") % 2).alias("app"), F.col("ts").cast("timestamp").alias("ts"), status.spark_metric_name(F.col("event_type")).alias("metric"),
        (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 3).cast("int"))).alias("arrives"))
    for path in _in_waves(spark, samples, _wave_of(F.col("arrives")), base):
        arriving = spark.readStream.schema(samples.schema).parquet(path)
        finish(start_rates(arriving, f"{base}/closed", f"{base}/checkpoint", 3600, "6 hours", **rates))
    now = rates_now(spark.read.parquet(f"{base}/closed"), spark.read.parquet(path), 3600, **rates)
    return now.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@registered
def threshold_status(spark, sf_dir):
    """Status colour per application and hour; the panel's step applies to events per hour here."""
    return _rates(spark, sf_dir).select(
        "app", "window_start", "events", status.threshold_status(F.col("events"), RATE_STEPS).alias("colour"))


@registered
def counter_increase(spark, sf_dir):
    """Hourly increase per user. Values are added as decimals, so the order does not matter."""
    samples = views.events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return (health.counter_increase(samples, "1 hour", ["user_id"])
            .withColumn("increase", F.col("increase").cast("double")))


@registered
def counter_increase_stream(spark, sf_dir):
    """The hourly increase from samples in three parts; the stream restarts for each and carries the last samples over."""
    base = shared_dir(spark, "increase")
    samples = views.events(spark, sf_dir).select("user_id", "ts", "event_id", F.col("value").cast("decimal(18,4)").alias("value"))
    log = IncreaseLog(spark, f"{base}/log", "1 hour", ["user_id"])
    for path in _in_waves(spark, samples, _wave_of(F.col("ts")), base):
        finish(log.start(spark.readStream.schema(samples.schema).parquet(path), f"{base}/checkpoint"))
    return log.read().withColumn("increase", F.col("increase").cast("double"))


@registered
def counter_rate(spark, sf_dir):
    samples = views.events(spark, sf_dir).select(
        (F.col("user_id") % 2).alias("app"), "user_id", "ts", "event_id", F.col("value").cast("decimal(18,4)"))
    return (health.counter_rate(samples, 3600, "app", ["user_id"])
            .withColumn("per_second", F.round("per_second", 4).cast("double")))


@registered
def cdc_lag(spark, sf_dir):
    samples = health.arrival_samples(views.event_messages(spark, sf_dir), "user_id")
    return (health.cdc_lag(samples, "1 hour", "user_id")
            .withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@registered
def sessions_by_state(spark, sf_dir):
    return health.sessions_by_state(views.sessions(spark, sf_dir), "activities", "Connector.*")
