"""Streams that Spark's own operators express, and ways to run a stream to its end.

State is keyed, bounded by watermarks, and restarts from the checkpoint; keyed.py has the streams with state of
their own, upserts.py the tables they keep up to date.
Sources and sinks are the caller's; `drain` runs a query over what is there and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuetide.streaming.upserts import upsert_batch


def exactly_once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows without repeats of their keys within the watermark's delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def bucket_counts(stream: DataFrame, time: str, size: str, delay: str, keys: list[str]) -> DataFrame:
    """Tumbling windows of event time per key, emitted once when the watermark has passed them."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, time: str, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Sessions that end after a pause."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run over what the source has, into Parquet, and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def publish(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], mode: str = "update") -> None:
    """Run over what the source has, each batch upserted into a table that upserts.read() gives at any time, and stop."""
    stream.writeStream.outputMode(mode).foreachBatch(upsert_batch(target, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
