"""Joins on time, set operations, precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions.times import micros
from skyplume.jobs.registry import query, table
from skyplume.jobs.series_jobs import HOURLY_SQL, hourly
from skyplume.operators import joins as J
from skyplume.operators import reports

HOUR = 3_600_000_000


@query(
    "asof_bracketed",
    f"""
WITH h AS ({HOURLY_SQL}), s AS (SELECT hour * {HOUR} AS t, level AS v FROM h WHERE event_type = 'view'),
q AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
p AS (SELECT q.event_id, q.us, s.t, s.v FROM q ASOF LEFT JOIN s ON q.us > s.t),
b AS (SELECT p.*, n.t AS nt, n.v AS nv FROM p ASOF LEFT JOIN s n ON p.us <= n.t)
SELECT event_id, CASE WHEN nt - t <= {2 * HOUR} THEN 'ok' ELSE 'gap' END AS status,
  round(CASE WHEN nt - t <= {2 * HOUR} THEN v + (us - t) / (nt - t) * (nv - v) END, 6) AS interpolated FROM b""",
)
def asof_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station's hourly level at the instant of each purchase."""
    station = hourly(spark, sf_dir).filter("event_type = 'view'").select((F.col("hour") * HOUR).alias("t"), "level")
    asked = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", micros("ts").alias("us"))
    rows = J.bracketed(asked, "event_id", "us", station, "t", "level", 2 * HOUR)
    return rows.select("event_id", F.when(F.col("status") == "ok", "ok").otherwise("gap").alias("status"), F.round("interpolated", 6).alias("interpolated"))


@query(
    "nearest_with_tolerance",
    f"""
SELECT p.event_id, v.event_id AS view_id, abs(epoch_us(p.ts) - epoch_us(v.ts)) AS distance
FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view' AND abs(epoch_us(p.ts) - epoch_us(v.ts)) <= {12 * HOUR}
WHERE p.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY distance, v.event_id) = 1""",
)
def nearest_with_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "event_id", micros("ts").alias("at"))
    seen = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), micros("ts").alias("view_at"))
    return J.nearest(bought, "event_id", "at", seen, "view_id", "view_at", 12 * HOUR, ["user_id"])


@query(
    "in_all_variants",
    "SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day FROM events GROUP BY ALL HAVING count(DISTINCT event_type) = 3",
)
def in_all_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return J.in_all(rows, ["user_id", "day"], "event_type", 3)


@query(
    "only_in_one",
    "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'click'",
)
def only_in_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    one, two = (rows.filter(F.col("event_type") == t).select("user_id", "day") for t in ("view", "click"))
    return one.distinct().join(two, ["user_id", "day"], "left_anti")


@query(
    "last_wins",
    """
SELECT user_id, date_trunc('hour', ts) AS hour, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1""",
)
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_id", "value", "ts")
    return J.latest(rows, ["user_id", "hour"], [F.col("ts"), F.col("event_id")], ["event_id", "value"])


@query(
    "precedence",
    """
WITH f AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY 1),
c AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' AND value > 40 GROUP BY 1),
r AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT u.user_id, coalesce(f.v, c.v, r.v) AS v, CASE WHEN f.v IS NOT NULL THEN 'full' WHEN c.v IS NOT NULL THEN 'consensus' WHEN r.v IS NOT NULL THEN 'reference' END AS origin
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN f USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN r USING (user_id)""",
)
def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    best = lambda t, low: e.filter((F.col("event_type") == t) & (F.col("value") > low)).groupBy("user_id").agg(F.max("value").alias("v"))
    return J.first_known(e.select("user_id").distinct(), "user_id", [("full", best("purchase", 60)), ("consensus", best("click", 40)), ("reference", best("view", -1))], "v")


@query(
    "left_with_default",
    """
WITH d AS (SELECT user_id, bool_or(event_type = 'error' AND value > 90) AS bad FROM events WHERE event_type IN ('purchase', 'error') AND value > 20 GROUP BY 1)
SELECT l.event_id, coalesce(NOT d.bad, false) AS trusted FROM events l LEFT JOIN d ON l.user_id = d.user_id WHERE l.event_type = 'signup'""",
)
def left_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without strong purchases or errors are unknown, so not trusted."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    known = e.filter("event_type in ('purchase', 'error') and value > 20").groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 90)).alias("bad"))
    return J.left_default(e.filter("event_type = 'signup'"), known, ["user_id"], (~F.col("bad")).alias("trusted"), False).select("event_id", "trusted")


@query(
    "runs_to_samples",
    """
WITH c AS (SELECT o_orderkey AS chunk, CAST(o_orderkey % 5 + 1 AS INTEGER) AS per FROM orders),
s AS (SELECT chunk, unnest(range(per)) AS i, per FROM c)
SELECT chunk, i, CAST(sum(chunk % 97 + i + 1) OVER (PARTITION BY chunk ORDER BY i ROWS UNBOUNDED PRECEDING) - (chunk % 97 + i + 1) AS BIGINT) AS position FROM s""",
)
def runs_to_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table expanded to samples with their byte positions within the chunk."""
    from skyplume.sources.boxes import expand_chunks

    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("per"))
    return expand_chunks(chunks, "chunk", "per", lambda i: F.col("chunk") % 97 + i + 1)


@query(
    "telemetry_pivot",
    """
SELECT l_orderkey, round(sum(CASE WHEN l_linenumber = 1 THEN l_quantity END), 6) AS p1, round(sum(CASE WHEN l_linenumber = 2 THEN l_quantity END) * 0.1, 6) AS p2,
  round(degrees(sum(CASE WHEN l_linenumber = 3 THEN l_quantity END)), 6) AS p3 FROM lineitem GROUP BY 1""",
)
def telemetry_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-attribute-value rows to columns with unit scaling."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return reports.scaled_fields(rows, "l_orderkey", "l_linenumber", "l_quantity", {1: ("p1", lambda c: F.round(c, 6)), 2: ("p2", lambda c: F.round(c * 0.1, 6)), 3: ("p3", lambda c: F.round(F.degrees(c), 6))})


@query(
    "top_by_score",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 8",
)
def top_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return reports.top_rows(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 8).drop("place", "l_partkey")
