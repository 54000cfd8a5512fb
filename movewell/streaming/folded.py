"""Tables of many small pieces, their closed part folded into files of a good size beside them."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.streaming.folders import finished, remove


class FoldedTable:
    """What a stream wrote piece by piece, without its small files.

    ``key`` numbers the pieces by partition columns alone, such as the batch or the day. ``fold`` writes the pieces beyond
    the last segment, up to a closed one, as ``segment=N``, in files of the session's advisory partition
    size; each row is rewritten once. Readers take finished segments and the pieces beyond, so that a fold at work, a failed one or
    one that is done changes no row. Pieces without a number stay as they are.
    """

    def __init__(self, spark: SparkSession, path: str, key: Column):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def segments(self) -> dict[int, datetime]:
        return finished(self.spark, f"{self.path}/segment=*")

    def _beyond(self, pieces: DataFrame) -> DataFrame:
        done = self.segments()
        return pieces.where(self.key.isNull() | (self.key > max(done))) if done else pieces

    def fold(self, pieces: DataFrame, upto: int) -> bool:
        """Fold the pieces up to one that no row will be added to any more; false if there are none beyond the last."""
        done = self.segments()
        if done and upto <= max(done):
            return False
        closed = self._beyond(pieces).where(self.key <= upto)
        closed.hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/segment={upto}")
        return True

    def read(self, pieces: DataFrame) -> DataFrame:
        done = sorted(self.segments())
        if not done:
            return pieces
        folded = self.spark.read.schema(pieces.schema).parquet(*[f"{self.path}/segment={number}" for number in done])
        return folded.unionByName(self._beyond(pieces))

    def clean_up(self, folder: str, age: timedelta, now: datetime | None = None) -> list[int]:
        """Remove the numbered pieces ``folder`` (as ``/outbox/texts/batch=``) names that were folded longer than ``age`` ago."""
        before = (now or datetime.now(timezone.utc)).astimezone(timezone.utc) - age
        old = max((number for number, written in self.segments().items() if written < before), default=-1)
        gone = sorted(number for number in finished(self.spark, f"{folder}*") if number <= old)
        for number in gone:
            remove(self.spark, f"{folder}{number}")
        return gone


def by_batch() -> Column:
    return F.col("batch")


def by_part() -> Column:
    """Days or months as numbers in their order."""
    return F.date_format("part", "yyyyMMdd").cast("int")
