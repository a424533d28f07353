"""Windows over event time. The same expressions serve a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and their summed value per hour and type; on a stream, events later than ``late`` are left out."""
    grouped = timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(
        F.col("window.start").alias("hour"), "event_type", "n", "value"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: runs of events with less than ``gap`` between neighbours."""
    grouped = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")
