"""Monthly spend over a stream: an addition, the engine's own work is in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum per key and window; events later than `late` are dropped by the watermark."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(key).alias("key"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "key", "n", "total")
    )
