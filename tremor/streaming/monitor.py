"""Continuous monitoring: power of event-time windows per channel, with late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_power(samples: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, channel, n, power, rms; ``samples``: ts timestamp, channel, y; streaming or not."""
    kept = samples.withWatermark("ts", late) if samples.isStreaming else samples
    sums = kept.groupBy(F.window("ts", window).alias("w"), "channel").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") * F.col("y")).alias("power"))
    return sums.select(F.col("w.start").alias("start"), "channel", "n", "power", F.sqrt("power").alias("rms"))
