"""Streaming ingestion.  The batch operators work on what these write; nothing here changes their results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_reads(stream: DataFrame, *, key: tuple[str, ...] = ("sample", "read"), time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream of records without repeats of a key within the watermark, whose state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def window_counts(stream: DataFrame, *, time: str = "ts", width: str = "1 hour", slide: str | None = None, by: tuple[str, ...] = ("event_type",), value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and key; also runs on a plain table, where the watermark has no effect."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    got = stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(stream: DataFrame, *, time: str = "ts", gap: str = "30 minutes", by: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: rows no further apart than ``gap``."""
    got = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return got.select(by, F.col("w.start").alias("session_start"), "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, *, every: str | None = None):
    """Starts appending a stream to Parquet, exactly once; without ``every`` it takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
