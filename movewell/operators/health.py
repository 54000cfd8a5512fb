"""Stream health from rows of metrics and progress: liveness, rates, increases, lag, sessions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from movewell.functions.status import matches_fully
from movewell.functions.time import moment
from movewell.sources.cdc import decode_envelope


def stream_liveness(progress: DataFrame, as_of: datetime, threshold: str, stream: str = "stream",
                    ts: str = "ts", streams: str = ".*") -> DataFrame:
    """1 for each stream that reported within ``threshold`` (an interval text) before ``as_of``, else 0."""
    latest = (progress.where(matches_fully(F.col(stream), streams))
              .groupBy(stream).agg(F.max(ts).alias("last_seen")))
    alive = F.col("last_seen") >= moment(as_of) - F.expr(f"INTERVAL {threshold}")
    return latest.withColumn("up", F.coalesce(alive, F.lit(False)).cast("int"))


def batch_rate(progress: DataFrame, length_seconds: int, app: str = "app", ts: str = "ts",
               name: str | None = None, names: str = ".*") -> DataFrame:
    """Progress events per second by application and window, without edge extrapolation."""
    selected = progress if name is None else progress.where(matches_fully(F.col(name), names))
    counted = (selected.groupBy(app, F.window(ts, f"{length_seconds} seconds").alias("_window"))
               .agg(F.count(F.lit(1)).alias("events")))
    return counted.select(
        app, F.col("_window.start").alias("window_start"), "events",
        (F.col("events") / F.lit(length_seconds)).alias("per_second"))


def _step(current: Column, previous: Column) -> Column:
    """Growth from one sample to the next; a drop means the counter restarted from zero."""
    return F.when(current < previous, current).otherwise(current - previous)


def counter_increase(samples: DataFrame, length: str, series: Sequence[str], ts: str = "ts",
                     value: str = "value", tie: str = "event_id") -> DataFrame:
    """Increase of a counter per series and window; a step counts where its later sample lies.

    A series is not kept whole in one task. Range partitioning on (series, time, tie) cuts
    hot series, windows and even equal timestamps into runs of even size. Steps inside a
    (series, run, window) piece come from lag; the steps between pieces come from a second
    lag over one row per piece, of which a series has no more than windows plus partitions.
    """
    order, piece = [ts, tie], [*series, "_run", "_start"]
    runs = (samples.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
            .select(*series, ts, tie, value)
            .repartitionByRange(*series, ts, tie)
            .withColumn("_run", F.spark_partition_id())
            .withColumn("_start", F.window(ts, length)["start"]))
    inside = Window.partitionBy(*piece).orderBy(*order)
    steps = runs.withColumn("_step", _step(F.col(value), F.lag(value).over(inside)))
    position = F.struct(*order)
    pieces = steps.groupBy(*piece).agg(
        F.sum("_step").alias("_inner"), F.count(F.lit(1)).alias("_samples"),
        F.min_by(value, position).alias("_first"), F.max_by(value, position).alias("_last"))
    between = Window.partitionBy(*series).orderBy("_start", "_run")
    border = _step(F.col("_first"), F.lag("_last").over(between))
    linked = pieces.withColumn("_border", border)
    nothing = F.lit(0)
    return (linked.groupBy(*series, F.col("_start").alias("window_start"))
            .agg(F.sum(F.coalesce("_inner", nothing) + F.coalesce("_border", nothing)).alias("increase"),
                 F.sum("_samples").alias("samples")))


def increase_after(samples: DataFrame, length: str, series: Sequence[str], carried: DataFrame | None = None,
                   ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Series, window_start, increase, samples and last of new samples, the steps going on from those ``carried``.

    carried: series and last, a struct of time, tie and value, one row per series. Samples move once, to their
    series and window, where all but one step of a window is made; the first steps of windows
    come from one row per window. A window of one series in one batch is taken to fit a task.
    """
    piece = [*series, "window_start"]
    known = samples.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(
        *series, F.window(ts, length)["start"].alias("window_start"), F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value")).alias("_s"))
    inside = Window.partitionBy(*piece).orderBy("_s.at", "_s.tie")
    steps = known.withColumn("_step", _step(F.col("_s.value"), F.lag("_s.value").over(inside)))
    pieces = steps.groupBy(*piece).agg(F.sum("_step").alias("_inner"), F.count(F.lit(1)).alias("samples"),
                                       F.min("_s").alias("_first"), F.max("_s").alias("last"))
    if carried is not None:
        nothing = [F.lit(None).cast(pieces.schema[c].dataType).alias(c) for c in ("window_start", "_inner", "samples")]
        pieces = pieces.unionByName(carried.select(*series, *nothing, F.col("last").alias("_first"), "last"))
    between = Window.partitionBy(*series).orderBy("_first.at", "_first.tie")
    border = _step(F.col("_first.value"), F.lag("last.value").over(between))
    grown = F.coalesce("_inner", F.lit(0)) + F.coalesce(border, F.lit(0))
    return pieces.select(*piece, grown.alias("increase"), "samples", "last").where("samples IS NOT NULL")


def counter_rate(samples: DataFrame, length_seconds: int, app: str, series: Sequence[str], ts: str = "ts",
                 value: str = "value", tie: str = "event_id") -> DataFrame:
    """Growth per second by application and window: the rates of its counters, added up."""
    grown = counter_increase(samples, f"{length_seconds} seconds", [app, *series], ts, value, tie)
    return (grown.groupBy(app, "window_start")
            .agg((F.sum("increase") / F.lit(length_seconds)).alias("per_second")))


def arrival_samples(messages: DataFrame, *stream: str, arrived: str = "timestamp") -> DataFrame:
    """Commit and arrival time of change messages; null where the connector gives no commit time."""
    decoded = decode_envelope(messages, *stream, arrived)
    return decoded.select(*stream, F.timestamp_millis("source_ts_ms").alias("committed"),
                          F.col(arrived).alias("arrived"))


def cdc_lag(samples: DataFrame, length: str, *stream: str) -> DataFrame:
    """Milliseconds behind the source per stream and window: of the last arrival, and the largest.

    Of messages that arrive at the same moment the one furthest behind counts as the last.
    """
    lag = F.timestamp_diff("MILLISECOND", F.col("committed"), F.col("arrived"))
    measured = samples.where(F.col("committed").isNotNull() & F.col("arrived").isNotNull()).withColumn("_lag", lag)
    return (measured.groupBy(*stream, F.window("arrived", length).alias("_window"))
            .agg(F.max(F.struct("arrived", "_lag"))["_lag"].alias("last_lag_ms"), F.max("_lag").alias("max_lag_ms"))
            .select(*stream, F.col("_window.start").alias("window_start"), "last_lag_ms", "max_lag_ms"))


def sessions_by_state(sessions: DataFrame, database: str, applications: str) -> DataFrame:
    """Number of database sessions per state, for one database and an application pattern."""
    return (sessions.where((F.col("datname") == database) & matches_fully(F.col("application_name"), applications))
            .groupBy("state").agg(F.count(F.lit(1)).alias("sessions")))
