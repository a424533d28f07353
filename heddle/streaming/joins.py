"""Joins and duplicates on streams. The same expressions serve a table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.streaming.events import timed


def followed(first: DataFrame, second: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Each row of ``first`` with each row of ``second`` of the same user that comes after it, ``within`` that time at most.

    A row that nothing follows has nulls; a stream puts it out when both watermarks (``late`` behind the newest event of each side) have passed
    the end of its time. State holds the rows of either side for that long, and no longer.
    """
    a = timed(first).select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = timed(second).select(F.col("user_id").alias("_user"), F.col("event_id").alias("next_id"), F.col("ts").alias("next_ts")).withWatermark("next_ts", late)
    on = F.expr(f"user_id = _user AND next_ts > first_ts AND next_ts <= first_ts + INTERVAL {within}")
    return a.join(b, on, "leftOuter").select("user_id", "first_id", "first_ts", "next_id", "next_ts")


def once(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One row for each key. A stream remembers a key until the watermark has passed its first row by ``late``, so its state is bounded;
    a repeat that comes later than that counts as new. Of a table, all repeats go, and the first by time stays."""
    marked = timed(rows).withWatermark("ts", late)
    if rows.isStreaming:
        return marked.dropDuplicatesWithinWatermark(keys)
    first = F.min_by(F.struct(*marked.columns), F.struct("ts", F.to_json(F.struct(*marked.columns))))
    return marked.groupBy(*keys).agg(first.alias("r")).select("r.*")


def dropped_late(progress: list) -> int:
    """How many rows a query's operators dropped because they came behind the watermark, from its progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
