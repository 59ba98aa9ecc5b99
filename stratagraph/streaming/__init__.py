"""Measurements as they arrive: the condition summary over windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, time: str, entity: str, condition: str, value: str, base: str, treated: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, entity, base, treated, change) of a stream or a table; rows later than the watermark are dropped by a stream."""
    mean = lambda label: F.avg(F.when(F.col(condition) == label, F.col(value)))
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, window).alias("window"), entity).agg(mean(base).alias("base"), mean(treated).alias("treated"))
    return out.withColumn("change", F.col("treated") - F.col("base"))
