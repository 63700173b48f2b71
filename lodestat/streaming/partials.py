"""The mergeable sums of the statistics over a stream of observations, by time window and source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """n, total and squares of values by window, source and concept; rows later than `late` are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", window), "source", "concept").agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    return sums.select(F.col("window.start").alias("start"), "source", "concept", "n", "total", "squares")
