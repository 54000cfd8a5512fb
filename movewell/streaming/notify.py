"""Notifications as a stream: a persisted barrier per partition and an outbox of texts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from movewell.operators.notifications import barriers, creations, may_hold_marker, notifications
from movewell.streaming.folded import FoldedTable, by_batch
from movewell.streaming.folders import finished
from movewell.streaming.runs import start

BARRIER_SCHEMA = "partition INT, barrier BIGINT"
BARRIER_SLOTS = 3
TEXTS = "partition INT, offset BIGINT, id INT, text STRING, batch BIGINT"


class Outbox:
    """Writes each micro-batch's notifications once, for a client to deliver.

    Both outputs are named after the batch, so a batch that is replayed after a failure
    overwrites its own files: no text is lost or doubled. The barrier of a partition stays
    known over restarts, and a restarted stream goes on posting where it stopped. Batches must
    come in offset order within a partition, as a topic source delivers them; inside a batch
    the order of rows does not matter.

    Markers are searched in partitions whose barrier is not known yet. Where the number of the
    topic's ``partitions`` is given and all have one, a batch is read once, for its texts.
    """

    def __init__(self, spark: SparkSession, path: str, partitions: int | None = None):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions

    def _barrier_path(self, batch_id: int) -> str:
        return f"{self.path}/barriers/slot={batch_id % BARRIER_SLOTS}"

    def barriers_after(self, batch_id: int) -> DataFrame:
        """Barriers known once the batch is done; none before the first."""
        if batch_id < 0:
            return self.spark.createDataFrame([], BARRIER_SCHEMA)
        return self.spark.read.schema(BARRIER_SCHEMA).parquet(self._barrier_path(batch_id))

    def on_batch(self, messages: DataFrame, batch_id: int) -> None:
        """Store the barriers known after this batch, then the texts beyond them.

        While markers are searched the batch is read twice rather than cached, since a back-fill arrives as
        one large batch; the first reading only searches the text of partitions that are still closed.
        """
        known = self.barriers_after(batch_id - 1)
        open_ones = [row["partition"] for row in known.select("partition").collect()]  # no more than the topic has
        gates = known
        if self.partitions is None or len(open_ones) < self.partitions:
            closed = messages.where(~F.col("partition").isin(open_ones)) if open_ones else messages
            gates = known.unionByName(barriers(creations(may_hold_marker(closed))))
        gates.coalesce(1).write.mode("overwrite").parquet(self._barrier_path(batch_id))
        texts = notifications(creations(messages), self.barriers_after(batch_id))
        texts.write.mode("overwrite").parquet(f"{self.path}/texts/batch={batch_id}")

    def _folded(self) -> FoldedTable:
        return FoldedTable(self.spark, f"{self.path}/folded", by_batch())

    def _pieces(self) -> DataFrame:
        return self.spark.read.schema(TEXTS).parquet(f"{self.path}/texts")

    def read(self) -> DataFrame:
        return self._folded().read(self._pieces())

    def fold(self) -> bool:
        """Put the texts of all batches but the newest, which may be written anew, into files of a good size."""
        batches = finished(self.spark, f"{self.path}/texts/batch=*")
        return len(batches) > 1 and self._folded().fold(self._pieces(), max(batches) - 1)

    def clean_up(self, age: timedelta, now: datetime | None = None) -> list[int]:
        """Remove the small files that were folded longer than ``age`` ago, beyond which no reader holds them."""
        return self._folded().clean_up(f"{self.path}/texts/batch=", age, now)

    def start(self, messages: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        return start(messages.writeStream.foreachBatch(self.on_batch).queryName("notify"), checkpoint, every)
