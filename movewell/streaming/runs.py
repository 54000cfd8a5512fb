"""Starting and finishing streaming queries."""

from __future__ import annotations

from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None,
          path: str | None = None) -> StreamingQuery:
    """Start with a checkpoint: every ``every``, or until all present input is used up."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()


def finish(query: StreamingQuery, seconds: int | None = None) -> StreamingQuery:
    """Wait for an available-now query to end; with a limit, one that takes longer is stopped and reported."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream did not finish in {seconds} s")
    return query
