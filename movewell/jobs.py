"""Command line: ``spark-submit movewell/jobs.py <job> ...`` or ``python -m movewell.jobs <job> ...``."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime, timedelta, timezone

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from movewell.fixed_values import GOLD_VIEW, HR_ADDRESS, HR_MODE, RATE_STEPS, UP_STEPS  # noqa: E402
from movewell.functions.status import threshold_status  # noqa: E402
from movewell.operators import distances, generator, health as stream_health, kpi, ordering, quality  # noqa: E402
from movewell.operators.daily import DAY, MONTH  # noqa: E402
from movewell.rules import DEFAULT, Rules, load_rules, read_bytes  # noqa: E402
from movewell.session import job_session  # noqa: E402
from movewell.sources.activities import append_activities, read_activities  # noqa: E402
from movewell.sources.cdc import read_cdc_stream  # noqa: E402
from movewell.sources.hr import hr_ids, load_hr, read_hr, write_hr  # noqa: E402
from movewell.sources.routes import parse_distances  # noqa: E402
from movewell.streaming.bronze import start_bronze, start_quarantine  # noqa: E402
from movewell.streaming.gold import INCREMENTAL, REBUILD, TRIGGER, GoldJob  # noqa: E402
from movewell.streaming.loads import LoadStatistics  # noqa: E402
from movewell.streaming.notify import Outbox  # noqa: E402
from movewell.streaming.progress import ProgressLog, batches, read_progress, stream_progress  # noqa: E402
from movewell.streaming.published import PublishedTable  # noqa: E402
from movewell.streaming.rates import rates_now, start_rates  # noqa: E402
from movewell.streaming.runs import finish  # noqa: E402


def _pairs(options: list[str]) -> dict[str, str]:
    return dict(option.split("=", 1) for option in options)


def _rules(spark: SparkSession, path: str | None) -> tuple[Rules, str]:
    return load_rules(path, spark) if path else (DEFAULT, "default")


def _sheet(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return read_hr(spark, args.hr, args.hr_format)


def _activity_source(args: argparse.Namespace) -> str | dict[str, str]:
    return args.activities or _pairs(args.option)


def _watched(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.progress:
        spark.streams.addListener(ProgressLog(spark, args.progress))


def bronze(spark: SparkSession, args: argparse.Namespace) -> None:
    messages = read_cdc_stream(spark, args.source, _pairs(args.option))
    _watched(spark, args)
    start_bronze(messages, args.table, args.checkpoint, args.format, args.every, args.by).awaitTermination()


def quarantine(spark: SparkSession, args: argparse.Namespace) -> None:
    messages = read_cdc_stream(spark, args.source, _pairs(args.option))
    _watched(spark, args)
    start_quarantine(messages, args.table, args.checkpoint, args.format, args.every).awaitTermination()


def gold(spark: SparkSession, args: argparse.Namespace) -> None:
    people = load_hr(_sheet(spark, args)).persist()  # HR is read once, as long as the job lives
    now = (lambda: datetime.now(timezone.utc).replace(tzinfo=None)) if args.trailing else None
    job = GoldJob(args.bronze, people, lambda: _rules(spark, args.rules), PublishedTable(spark, args.table), args.mode,
                  args.format, args.view, args.catalog, now, args.by)
    _watched(spark, args)
    job.start(args.checkpoint, args.every, **_pairs(args.option)).awaitTermination()


def notify(spark: SparkSession, args: argparse.Namespace) -> None:
    messages = read_cdc_stream(spark, args.source, _pairs(args.option))
    _watched(spark, args)
    Outbox(spark, args.outbox, args.partitions).start(messages, args.checkpoint, args.every).awaitTermination()


def validate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Print the statistics, keep the evidence if a folder is given, and fail if a rule failed."""
    suite = quality.ACTIVITY_SUITE
    if args.suite:
        suite = quality.suite_from_json(read_bytes(args.suite, spark).decode("utf-8"))
    suite = quality.with_date_bounds(quality.without_column(suite, "commentaire"), args.as_of)
    rows = read_activities(spark, _activity_source(args))
    references = {"employee_id": hr_ids(load_hr(_sheet(spark, args)))}
    if args.loads:  # the table is partitioned by load, and only new loads are evaluated
        counts = LoadStatistics(spark, args.loads, suite)
        print("evaluated", counts.evaluate(rows, references, "load"))
        statistics = quality.evaluated(counts.statistics())
    else:
        statistics = quality.evaluated(quality.dq_statistics(rows, suite, references))
    statistics.orderBy("rule_no").show(len(suite), truncate=False)
    quality.dq_summary(statistics).show(truncate=False)
    if args.evidence:
        quality.dq_violations(rows, suite, references).write.mode("overwrite").parquet(f"{args.evidence}/violations")
        quality.invalid_employee_ids(rows, references["employee_id"]).write.mode("overwrite").parquet(
            f"{args.evidence}/invalid_ids")
    quality.require_success(statistics)


def addresses(spark: SparkSession, args: argparse.Namespace) -> None:
    """Addresses to ask the routing service for, one row each."""
    distances.distinct_addresses(_sheet(spark, args), HR_ADDRESS).write.mode("overwrite").parquet(args.out)


def enrich(spark: SparkSession, args: argparse.Namespace) -> None:
    """HR with the distances of stored routing answers (address, body), checked against the rules."""
    known = parse_distances(spark.read.parquet(args.responses)).withColumnRenamed("address", HR_ADDRESS)
    people = distances.distance_enrich(_sheet(spark, args), known, HR_ADDRESS).withColumnRenamed(HR_MODE, "moyen_dep")
    checked = distances.declaration_check(people, _rules(spark, args.rules)[0])
    write_hr(checked.withColumnRenamed("moyen_dep", HR_MODE), args.out)


def generate(spark: SparkSession, args: argparse.Namespace) -> None:
    """A year of activities by start time, then the marker; or a single probe activity."""
    target = _activity_source(args)
    if args.probe:
        append_activities(generator.probe_activity(spark, args.as_of), target)
        return
    ids = load_hr(_sheet(spark, args)).select("employee_id").dropna()
    rows = generator.generate_activities(ids, args.as_of, args.seed)
    append_activities(ordering.activities_by_date(rows, tie="employee_id"), target)
    append_activities(generator.backfill_marker(spark, args.as_of), target)


def indicators(spark: SparkSession, args: argparse.Namespace) -> None:
    """Print the totals; the indicators of all units are written to a folder."""
    PublishedTable(spark, args.table).register(GOLD_VIEW)
    kpi.kpi_total(spark).show(truncate=False)
    kpi.kpi_by_unit(spark).write.mode("overwrite").parquet(args.out)


def fold(spark: SparkSession, args: argparse.Namespace) -> None:
    """Put the outbox's small files into files of a good size, and remove those folded a number of hours ago."""
    outbox = Outbox(spark, args.outbox)
    print("folded" if outbox.fold() else "nothing to fold", "- removed", outbox.clean_up(timedelta(hours=args.hours)))


def clean(spark: SparkSession, args: argparse.Namespace) -> None:
    """Remove gold versions older than a number of hours, with their changes, never the newest."""
    print("removed", PublishedTable(spark, args.table).clean_up(timedelta(hours=args.hours)))


def health(spark: SparkSession, args: argparse.Namespace) -> None:
    """Liveness and batch rates of the streams in a progress table, and the lag of a change log, as tables."""
    rows = read_progress(spark, args.progress)
    reports = batches(rows)
    up = stream_health.stream_liveness(rows, args.as_of, args.threshold)
    up.withColumn("colour", threshold_status(F.col("up"), UP_STEPS)).write.mode("overwrite").parquet(f"{args.out}/up")
    if args.checkpoint:  # only the rows since the last run are read, and those of windows still open
        finish(start_rates(batches(stream_progress(spark, args.progress)), f"{args.out}/closed", args.checkpoint, args.window, app="stream"))
        rates = rates_now(spark.read.parquet(f"{args.out}/closed"), reports, args.window, app="stream")
    else:
        rates = stream_health.batch_rate(reports, args.window, app="stream")
    rates.withColumn("colour", threshold_status(F.col("events"), RATE_STEPS)).write.mode("overwrite").parquet(f"{args.out}/rates")
    window = F.window("ts", f"{args.window} seconds")["start"].alias("window_start")
    sums = [F.sum(c).alias(c) for c in ("input_rows", "unreadable", "empty")]
    reports.groupBy("stream", window).agg(*sums).write.mode("overwrite").parquet(f"{args.out}/input")
    if args.messages:
        samples = stream_health.arrival_samples(spark.read.parquet(args.messages))
        stream_health.cdc_lag(samples, f"{args.window} seconds").write.mode("overwrite").parquet(f"{args.out}/lag")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="movewell")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(run, *needed: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for name in needed:
            sub.add_argument(f"--{name}", required=True)
        return sub

    def stream(sub: argparse.ArgumentParser, every: str | None) -> None:
        sub.add_argument("--every", default=every, help="pace; 'once' uses up the present input and ends")
        sub.add_argument("--format", default="parquet", help="table format")
        sub.add_argument("--progress", help="table to which a row for every batch is added")

    def source(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--source", default="kafka", help="kafka, or a file format")
        sub.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="source option")

    def people(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--hr", required=True)
        sub.add_argument("--hr-format", default="csv")

    def activities(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--activities", help="folder; leave out for a database")
        sub.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="database option")
        sub.add_argument("--as-of", type=datetime.fromisoformat,
                         default=datetime.now(timezone.utc).replace(tzinfo=None))

    sub = job(bronze, "table", "checkpoint")
    source(sub)
    stream(sub, "10 seconds")
    sub.add_argument("--by", choices=(DAY, MONTH), help="partition bronze by the time of the activity")
    sub = job(quarantine, "table", "checkpoint")
    source(sub)
    stream(sub, "10 seconds")
    sub = job(gold, "bronze", "table", "checkpoint")
    people(sub)
    stream(sub, TRIGGER)
    sub.add_argument("--rules")
    sub.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="bronze stream option")
    sub.add_argument("--mode", choices=(INCREMENTAL, REBUILD), default=INCREMENTAL)
    sub.add_argument("--trailing", action="store_true", help="count the rules' trailing days only; incremental needs bronze --by the same")
    sub.add_argument("--by", choices=(DAY, MONTH), default=DAY, help="how bronze is partitioned, for trailing days")
    sub.add_argument("--view", default=GOLD_VIEW, help="SQL name of the newest version")
    sub.add_argument("--catalog", action="store_true", help="make the view one of the catalog, for other sessions")
    sub = job(notify, "outbox", "checkpoint")
    sub.add_argument("--partitions", type=int, help="of the topic; once all are open, markers are searched no more")
    source(sub)
    stream(sub, "10 seconds")
    sub = job(validate)
    people(sub)
    activities(sub)
    sub.add_argument("--suite")
    sub.add_argument("--loads", help="counts of the loads evaluated before; the activities are partitioned by load")
    sub.add_argument("--evidence")
    people(job(addresses, "out"))
    sub = job(enrich, "responses", "out")
    people(sub)
    sub.add_argument("--rules")
    sub = job(generate)
    sub.add_argument("--hr")
    sub.add_argument("--hr-format", default="csv")
    activities(sub)
    sub.add_argument("--seed", type=int, default=0)
    sub.add_argument("--probe", action="store_true")
    job(indicators, "table", "out")
    job(fold, "outbox").add_argument("--hours", type=float, default=24.0)
    job(clean, "table").add_argument("--hours", type=float, default=24.0)
    sub = job(health, "progress", "out")
    sub.add_argument("--threshold", default="1 minute")
    sub.add_argument("--window", type=int, default=300, help="seconds")
    sub.add_argument("--checkpoint", help="keep rates up as a stream between runs, with this checkpoint")
    sub.add_argument("--messages", help="change messages with their arrival time, for the lag")
    sub.add_argument("--as-of", type=datetime.fromisoformat, default=datetime.now(timezone.utc).replace(tzinfo=None))
    return parser


def main(arguments: list[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    if getattr(args, "every", None) == "once":
        args.every = None
    args.run(job_session(f"movewell-{args.job}"), args)


if __name__ == "__main__":
    main()
