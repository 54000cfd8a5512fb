"""Rates and increases kept up as samples arrive, so that no run reads the samples of all time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from movewell.operators.health import batch_rate, increase_after
from movewell.streaming.folders import finished
from movewell.streaming.published import LATEST, PublishedTable
from movewell.streaming.runs import start


def start_rates(samples: DataFrame, path: str, checkpoint: str, length_seconds: int, lateness: str = "1 minute",
                every: str | None = None, **columns: str) -> StreamingQuery:
    """Append the rates of closed windows, once each. Samples up to ``lateness`` behind the newest still count."""
    ts = columns.get("ts", "ts")
    rates = batch_rate(samples.withWatermark(ts, lateness), length_seconds, **columns)
    writer = rates.writeStream.format("parquet").outputMode("append").queryName("rates")
    return start(writer, checkpoint, every, path)


def rates_now(closed: DataFrame, samples: DataFrame, length_seconds: int, **columns: str) -> DataFrame:
    """Closed windows as the stream wrote them, and those still open from the samples since; one value passes the driver."""
    ts = columns.get("ts", "ts")
    last = closed.agg(F.max("window_start")).first()[0]
    if last is None:
        return batch_rate(samples, length_seconds, **columns)
    since = F.col(ts) >= F.lit(last).cast(samples.schema[ts].dataType) + F.make_dt_interval(secs=F.lit(length_seconds))
    return closed.unionByName(batch_rate(samples.where(since), length_seconds, **columns))


class IncreaseLog:
    """Increase of counters by series and window over samples that come batch by batch.

    Only the new samples move, once. Of each series the last sample is carried over: the first step of a batch
    starts there. Steps count where their later sample lies, so increases add up over batches. A replayed
    batch finds the samples carried before it and writes the same again. Within a batch order does not
    matter; of a series that comes in late, behind the carried sample, the steps among the late ones count.
    """

    def __init__(self, spark: SparkSession, path: str, length: str, series: Sequence[str], **columns: str):
        self.spark, self.path, self.length, self.series, self.columns = spark, path.rstrip("/"), length, list(series), columns
        self.carried = PublishedTable(spark, f"{self.path}/carried", key="series_key", newest=LATEST)

    def on_batch(self, samples: DataFrame, batch_id: int) -> None:
        whole, marks = self.carried.latest(), {"kind": "last"}
        if whole is not None and (batch_id <= whole["batch_id"] or batch_id in self.carried.batches()):
            return
        before = self.carried.read().drop("series_key") if self.carried.versions() else None
        steps = f"{self.path}/steps/batch={batch_id}"
        pieces = increase_after(samples, self.length, self.series, before, **self.columns)
        pieces.write.mode("overwrite").parquet(steps)
        last = self.spark.read.schema(pieces.schema).parquet(steps).groupBy(*self.series).agg(F.max("last").alias("last"))
        last = last.select(F.to_json(F.struct(*self.series)).alias("series_key"), *self.series, "last")
        if before is None:
            self.carried.publish(last, batch_id, **marks)
        else:
            self.carried.publish_changes(last, batch_id, **marks)

    def read(self) -> DataFrame:
        """Series, window_start, increase and samples over all finished batches."""
        steps = self.spark.read.parquet(f"{self.path}/steps").where(F.col("batch").isin(list(finished(self.spark, f"{self.path}/steps/batch=*"))))
        return steps.groupBy(*self.series, "window_start").agg(F.sum("increase").alias("increase"), F.sum("samples").alias("samples"))

    def start(self, samples: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        return start(samples.writeStream.foreachBatch(self.on_batch).queryName("increase"), checkpoint, every)
