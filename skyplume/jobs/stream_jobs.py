"""Streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyplume.jobs.registry import query, table
from skyplume.streaming.episodes import session_counts


@query(
    "activity_sessions",
    """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events),
f AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 21600000000 THEN 1 ELSE 0 END AS f FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS id FROM f)
SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, id""",
)
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(table(spark, sf_dir, "events").select("user_id", "ts", "value"), "6 hours", "1 day")
