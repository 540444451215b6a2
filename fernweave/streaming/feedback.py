"""Streaming forms: messages once, counts in windows of event time, running state, and batches into a table.

All functions take a streaming or a batch DataFrame; the watermark has no effect on a
batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.operators.delivery import new_messages


def once(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Each message once, repeats being known for as long as `delay` behind the latest time."""
    watched = stream.withWatermark(time, delay)
    return watched.dropDuplicatesWithinWatermark(list(keys)) if stream.isStreaming else watched.dropDuplicates(list(keys))


def window_counts(stream: DataFrame, time: str, size: str, keys: Sequence[str], delay: str, slide: str | None = None) -> DataFrame:
    """(`start`, `end`, `keys`, `n`): counts in tumbling or sliding windows; rows later than `delay` are left out of closed windows."""
    span = F.window(time, size, slide) if slide else F.window(time, size)
    counted = stream.withWatermark(time, delay).groupBy(span.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(stream: DataFrame, time: str, gap: str, keys: Sequence[str], delay: str) -> DataFrame:
    """(`start`, `end`, `keys`, `n`): counts in sessions that end after a gap without rows."""
    counted = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def append_new(path: str, keys: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A batch function that appends only messages whose keys the table at `path` lacks."""

    def write(batch: DataFrame, epoch: int) -> None:
        columns = [F.col(c) for c in order]
        try:
            stored = batch.sparkSession.read.parquet(path).select(*keys)
        except Exception as missing:  # the folder doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            stored = batch.select(*keys).limit(0)
        new_messages(stored, batch, keys, columns).write.mode("append").parquet(path)

    return write
