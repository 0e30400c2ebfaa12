"""Windowed statistics of pulse streams; the same functions serve batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pulse_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """n, mean and extremes of value by channel and time window (start).

    events: ts, channel, value.  late sets the watermark of a stream: windows
    that end before the latest time less it are final, and state is dropped.
    """
    if late is not None:
        events = events.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.groupBy("channel", window.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select("channel", F.col("w.start").alias("start"), "n", "mean", "low", "high")


def first_pulses(events: DataFrame, late: str) -> DataFrame:
    """Each (channel, pulse) once within the watermark: later copies are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["channel", "pulse"])
