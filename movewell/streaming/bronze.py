"""Change stream to bronze: decode and append, one row per message; what cannot be decoded is counted and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from movewell.operators.daily import part_column
from movewell.sources.cdc import EMPTY, UNREADABLE, decode_changes, decode_with_problem, flattened
from movewell.streaming.runs import start

DECODING = "decoding"  # name of the counts that each batch reports


def counted(decoded: DataFrame) -> DataFrame:
    """The same rows; each batch reports how many messages it had, and how many gave no activity and why."""
    return decoded.observe(DECODING, F.count(F.lit(1)).alias("messages"), F.count_if(F.col("problem") == UNREADABLE).alias("unreadable"),
                           F.count_if(F.col("problem") == EMPTY).alias("empty"))


def start_bronze(messages: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 every: str | None = None, by: str | None = None) -> StreamingQuery:
    """Append decoded messages to the bronze table. No shuffle: tasks follow the source's splits.

    ``by`` partitions the table by the day or month of the activity; messages without one get a partition of their own.
    """
    rows = flattened(counted(decode_with_problem(messages)))
    if by:
        rows = rows.withColumn("part", part_column(by))
    writer = rows.writeStream.format(fmt).outputMode("append").queryName("bronze")
    return start(writer.partitionBy("part") if by else writer, checkpoint, every, path)


def start_changes(messages: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                  every: str | None = None) -> StreamingQuery:
    """Append changes with their operation and offset: a bronze that current_rows can apply."""
    writer = decode_changes(messages).writeStream.format(fmt).outputMode("append").queryName("changes")
    return start(writer, checkpoint, every, path)


def start_quarantine(messages: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                     every: str | None = None) -> StreamingQuery:
    """Append the unreadable messages as they came, with partition and offset, for someone to look at.

    A stream of its own beside bronze, with its own checkpoint: neither waits for the other, and each of the two
    tables is written exactly once by Spark's own sink.
    """
    kept = decode_with_problem(messages, "partition", "offset", "value").where(F.col("problem") == UNREADABLE)
    writer = kept.select("partition", "offset", "value", "problem").writeStream.format(fmt).outputMode("append")
    return start(writer.queryName("quarantine"), checkpoint, every, path)
