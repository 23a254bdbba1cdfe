"""Windowed aggregates with watermarks. The functions take batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, size: str, keys: list[str], aggregates: dict[str, Column], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by tumbling or sliding windows and keys; in a stream, rows later than ``late`` are left out and state is bounded by it."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    grouped = source.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def session_counts(df: DataFrame, time: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows of each session: a key's rows no further apart than ``gap``."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    grouped = source.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def deduplicated(df: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One row of each key; in a stream, within the watermark."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
