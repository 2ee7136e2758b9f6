"""Coverage of station records, summary rows, text fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.jobs.registry import query, table
from skyplume.operators import reports


@query(
    "month_gaps",
    """
WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
g AS (SELECT o_custkey, unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM m GROUP BY 1)
SELECT g.o_custkey, g.month FROM g ANTI JOIN m ON g.o_custkey = m.o_custkey AND g.month = m.month""",
)
def month_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months without a record between each station's first and last."""
    return reports.missing_months(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")


@query(
    "coverage_verdict",
    """
WITH c AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) FILTER (o_orderdate BETWEEN '1996-01-01' AND '1996-12-31') AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN b < '1996-01-01' THEN 'before' WHEN a > '1996-12-31' THEN 'after' WHEN n = 0 THEN 'hole' WHEN a > '1996-01-01' OR b < '1996-12-31' THEN 'partial' ELSE 'full' END AS verdict FROM c""",
)
def coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each customer's orders lie to a year; coverage of an instant is ``coverage_by_margin``."""
    day = lambda d: F.lit(d).cast("timestamp")
    return reports.range_verdict(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", day("1996-01-01"), day("1996-12-31"))


@query(
    "detail_and_average",
    """
WITH d AS (SELECT l_returnflag AS name, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1)
SELECT * FROM d UNION ALL SELECT 'AVERAGE', round(avg(l_quantity), 6), round(avg(l_discount), 6) FROM lineitem WHERE l_shipdate BETWEEN '1996-01-01' AND '1997-12-31'""",
)
def detail_and_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per flag and a summary row over the window only."""
    rows = table(spark, sf_dir, "lineitem")
    values = [F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount")]
    inside = F.col("l_shipdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp"))
    return reports.with_summary(rows.withColumn("name", F.col("l_returnflag")), "name", values, inside, "AVERAGE")


@query(
    "quality_flags",
    """
WITH c AS (SELECT user_id, count(*) AS n, avg(value) AS m, max(value) AS hi, stddev_pop(value) / nullif(avg(value), 0) AS cv FROM events GROUP BY 1),
f AS (SELECT user_id, [x FOR x IN [CASE WHEN n < 60 THEN 'few rows' END, CASE WHEN hi > 150 THEN 'spike' END, CASE WHEN cv > 1.1 THEN 'unsteady' END, CASE WHEN m > 20 THEN '[i] strong' END] IF x IS NOT NULL] AS flags FROM c)
SELECT user_id, array_to_string(flags, '; ') AS flags, CASE len([x FOR x IN flags IF NOT starts_with(x, '[i]')]) WHEN 0 THEN 'ok' WHEN 1 THEN 'check' WHEN 2 THEN 'check' ELSE 'doubtful' END AS grade FROM f""",
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.max("value").alias("hi"), F.stddev_pop("value").alias("sd"))
    cv = F.col("sd") / F.nullif(F.col("m"), F.lit(0.0))
    flags = {"few rows": F.col("n") < 60, "spike": F.col("hi") > 150, "unsteady": cv > 1.1, "[i] strong": F.col("m") > 20}
    return reports.flagged(c, flags).select("user_id", "flags", "grade")


@query(
    "json_fields",
    "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1",
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k.try_cast("long")).alias("total"), F.countDistinct(k).alias("kinds"))


@query(
    "stamp_in_name",
    r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS folder, TRY_CAST(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1) AS BIGINT) AS number FROM pages""",
)
def stamp_in_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^https?://([^/]+)/").alias("host"), part("/([a-z]{2})/").alias("folder"), part(r"/([0-9]+)(?:[?#]|$)").try_cast("long").alias("number"))


@query(
    "unit_inference",
    """
SELECT p_partkey, CASE WHEN p_type LIKE '%E' THEN 'native' WHEN p_size >= 40 THEN 'native' ELSE 'work' END AS unit,
  CASE WHEN p_type LIKE '%E' OR p_size >= 40 THEN p_size * 0.5::DOUBLE ELSE p_size::DOUBLE END AS work_px,
  CASE WHEN p_retailprice < 950 THEN true WHEN p_retailprice > 1050 THEN false END AS fits FROM part""",
)
def unit_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit told from the name, else from the size; and a verdict of three states."""
    size = F.col("p_size")
    native = reports.is_native(F.col("p_type"), size, 40, ("E",))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(native, "native").otherwise("work").alias("unit"), reports.working_pixels(size, native, 0.5).alias("work_px"), reports.fits(F.col("p_retailprice"), 950, 1050).alias("fits"))


@query(
    "local_time",
    "SELECT event_id, (ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'America/Santiago' AS local_ts FROM events",
)
def local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_utc_timestamp("ts", "America/Santiago").alias("local_ts"))


@query(
    "steadiness_ranking",
    """
SELECT event_type, user_id, round(stddev_pop(value) / nullif(avg(value), 0), 6) AS cv, row_number() OVER (PARTITION BY event_type ORDER BY count(*) < 15 DESC, round(stddev_pop(value) / nullif(avg(value), 0), 6), user_id) AS place
FROM events GROUP BY event_type, user_id QUALIFY place <= 15""",
)
def steadiness_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 first of each type: those with too few rows, then the steadiest."""
    rows = reports.steadiest(table(spark, sf_dir, "events").select("event_type", "user_id", "value"), ["event_type"], "user_id", F.col("value"), 15, 15)
    return rows.withColumn("place", F.col("place").cast("long"))
