"""Streaming forms of the region statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_roi_series(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, mean and sum per label and time window of a stream of (ts, label, value).

    State for a window is dropped once the watermark has passed its end.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "label")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "label", "n", "mean", "total")
    )
