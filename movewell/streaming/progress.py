"""Progress of streaming queries as rows for the health operators, kept beyond Spark's short memory."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from datetime import datetime, timezone
from threading import Condition, Event, Lock, Thread

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS_SCHEMA = ("stream STRING, batch_id BIGINT, ts TIMESTAMP, input_rows BIGINT, "
                   "rows_per_second DOUBLE, duration_ms BIGINT, unreadable BIGINT, empty BIGINT")
PACE = 10.0  # seconds between two heartbeats


class ProgressLog(StreamingQueryListener):
    """Appends a row for every batch, and a heartbeat (batch_id null) for every stream that lives on without one.

    Heartbeats come from Spark's idle reports, and every ``pace`` seconds for streams that have given no row
    since, such as one in a long batch. Rows are written every ``pace`` seconds, when ``piece`` rows
    wait and when a query ends; they leave memory once they are written. Register with
    ``spark.streams.addListener``; ``close`` ends the clock and writes what waits.
    """

    def __init__(self, spark: SparkSession, path: str, piece: int = 100, pace: float = PACE):
        self.spark, self.path, self.piece, self.pace = spark, path, piece, pace
        self._rows: list[tuple] = []
        self._lock, self._writing = Condition(), Lock()
        self._names: dict[str, str] = {}
        self._heard: set[str] = set()
        self._ended: set[str] = set()
        self._stopped = Event()
        self._clock = Thread(target=self._tick, daemon=True, name="progress-log")
        self._clock.start()

    def _add(self, query: str, *row) -> bool:
        with self._lock:
            self._heard.add(query)
            self._rows.append((self._names.get(query), *row))
            return len(self._rows) >= self.piece

    def _beat(self, query: str, when: datetime) -> None:
        self._add(query, None, when, 0, 0.0, None, None, None)

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self._names[str(event.runId)] = event.name
        self._beat(str(event.runId), datetime.fromisoformat(event.timestamp))

    def onQueryIdle(self, event) -> None:
        self._beat(str(event.runId), datetime.fromisoformat(event.timestamp))

    def onQueryProgress(self, event) -> None:
        report = event.progress
        with self._lock:
            self._names[str(report.runId)] = report.name
        decoding = report.observedMetrics.get("decoding")
        problems = (decoding["unreadable"], decoding["empty"]) if decoding else (None, None)
        full = self._add(str(report.runId), report.batchId, datetime.fromisoformat(report.timestamp), report.numInputRows,
                         float(report.inputRowsPerSecond or 0.0), report.durationMs.get("triggerExecution"), *problems)
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()
        with self._lock:
            self._names.pop(str(event.runId), None)
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def _tick(self) -> None:
        while not self._stopped.wait(self.pace):
            with self._lock:
                silent, self._heard = set(self._names) - self._heard, set()
            try:
                active = {str(query.runId) for query in self.spark.streams.active}
            except Exception:  # the session has ended, and with it all streams
                return
            for query in silent & active:
                self._beat(query, datetime.now(timezone.utc))
            with self._lock:
                self._heard -= silent  # these beats are no sign that the stream reports by itself
            self.flush()

    def close(self) -> None:
        self._stopped.set()
        self._clock.join()
        self.flush()

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Whether all reports of a query that ended have arrived, within the time given."""
        with self._lock:
            return self._lock.wait_for(lambda: str(query.runId) in self._ended, seconds)

    def flush(self) -> None:
        """Write what waits. Rows of a write that fails stay and are written with the next one."""
        with self._writing:
            with self._lock:
                rows = list(self._rows)
            if not rows:
                return
            try:
                self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            except Exception:
                logging.getLogger(__name__).warning("%d progress rows wait for another try", len(rows), exc_info=True)
                return
            with self._lock:
                del self._rows[:len(rows)]


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a progress table, heartbeats among them."""
    return spark.read.schema(PROGRESS_SCHEMA).parquet(path)


def stream_progress(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same table as a stream."""
    return spark.readStream.schema(PROGRESS_SCHEMA).options(**options).parquet(path)


def batches(progress: DataFrame) -> DataFrame:
    """The rows that report a batch; a table or a stream."""
    return progress.where(F.col("batch_id").isNotNull())


def progress_rows(spark: SparkSession, queries: Iterable[StreamingQuery]) -> DataFrame:
    """The last reports Spark itself keeps for each query (100 by default); ProgressLog keeps all."""
    rows = [
        (report["name"], report["batchId"], datetime.fromisoformat(report["timestamp"]),
         report["numInputRows"], float(report.get("inputRowsPerSecond") or 0.0),
         report["durationMs"].get("triggerExecution"), *(
             [report["observedMetrics"]["decoding"][name] for name in ("unreadable", "empty")]
             if "decoding" in (report["observedMetrics"] or {}) else [None, None]))
        for query in queries for report in query.recentProgress
    ]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)
