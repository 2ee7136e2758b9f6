"""Episodes of activity as a stream: session windows with a watermark. Beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplume.functions.times import micros


def session_counts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user's events, batch or stream: start, end, rows and sum; rows later than ``late`` are dropped on a stream."""
    at = events.withWatermark("ts", late)
    rows = at.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("user_id", micros("w.start").alias("start_us"), micros("w.end").alias("end_us"), "n", "total")
