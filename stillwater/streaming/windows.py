"""Windowed counts over a stream of events (extras of this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_of_key(events: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """One event a key: later ones with the same key are the same request."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
