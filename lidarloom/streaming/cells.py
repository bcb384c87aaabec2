"""Incremental cell statistics: count, mean and squared deviations merge, so a stream of points keeps them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_cells(points: DataFrame, size: float) -> DataFrame:
    """Counts, means and population deviations of height per strip and square cell, for batch or streaming input. The
    state is one row per cell."""
    z = F.col("z")
    g = points.groupBy("strip", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    return g.agg(F.count("*").alias("n"), F.avg(z).alias("z_mean"), F.stddev_pop(z).alias("z_std"), F.min(z).alias("z_min"), F.max(z).alias("z_max"))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of ``value`` per event type and window of ``ts``; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
