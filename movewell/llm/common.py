"""What several operators share: reading tables, shared folders, folds and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from movewell.session import shared_dir
from movewell.streaming.folders import remove

BATCH_ROWS = 256
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Few megabytes per Arrow batch, the same for all operators: a task then holds little beside its own data."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Just the id and the whole text, under fixed names, so that no other column can clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Few rows per Arrow batch: very long texts then cannot fill a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that what is made of a piece stays small. Spark bounds a batch's bytes."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and survives lost executors."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    made = frame.sparkSession.read.schema(frame.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*frames: DataFrame) -> None:
    """Remove what ``stored`` wrote for these frames, once everything made of them is stored itself."""
    for frame in frames:
        remove(frame.sparkSession, frame.stored_at)


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id's text, modulo the number of folds."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(folds)


def share_kept(key: Column, share: Column, salt: str = "sample") -> Column:
    """A repeatable sample: true for about ``share`` of all keys, by the hash of key and salt alone."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(steps)) < share * F.lit(steps)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda inside refers to it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
