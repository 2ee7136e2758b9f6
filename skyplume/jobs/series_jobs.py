"""Ordered series: summaries, smoothing, gaps, runs, episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions import circular as C
from skyplume.functions.guards import finite
from skyplume.functions.times import micros
from skyplume.jobs.registry import query, table
from skyplume.operators import histograms as H
from skyplume.operators import quantiles as Q
from skyplume.operators import series as S

#: Angles of the events in both forms.
AZ_SQL = "((value * 7) % 360 + 360) % 360"
HOURLY_SQL = "SELECT event_type, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS hour, count(*) AS n, avg(value) AS level FROM events GROUP BY ALL"


def azimuth():
    return C.turned(F.col("value") * 7)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.floor(micros("ts") / 3600000000.0).alias("hour"), "value")
    return rows.groupBy("event_type", "hour").agg(F.count("*").alias("n"), F.avg("value").alias("level"))


@query(
    "wind_summary",
    """
WITH e AS (SELECT event_type, value, ((value * 7) % 360 + 360) % 360 AS az FROM events)
SELECT event_type, count(*) AS n,
  round(((degrees(atan2(sum(value * sin(radians(az))), sum(value * cos(radians(az))))) % 360) + 360) % 360, 6) AS mean_dir,
  round(degrees(sqrt(greatest(-2 * ln(greatest(sqrt(pow(avg(sin(radians(az))), 2) + pow(avg(cos(radians(az))), 2)), 1e-12)), 0))), 6) AS spread,
  round(avg(value), 6) AS mean_speed, round(median(value), 6) AS median_speed, round(min(value), 6) AS min_speed, round(max(value), 6) AS max_speed
FROM e GROUP BY event_type""",
)
def wind_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "value", azimuth().alias("az"))
    value = finite(F.col("value"))
    summary = rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(C.circular_mean(F.col("az"), F.col("value")), 6).alias("mean_dir"), F.round(C.circular_spread(F.col("az")), 6).alias("spread"),
        F.round(F.avg(value), 6).alias("mean_speed"), F.round(F.min(value), 6).alias("min_speed"), F.round(F.max(value), 6).alias("max_speed"),
    )
    middle = Q.quantiles(rows, ["event_type"], F.col("value"), [0.5], ["median_speed"])
    return summary.join(F.broadcast(middle.withColumn("median_speed", F.round("median_speed", 6))), "event_type")


@query(
    "robust_noise",
    """
WITH m AS (SELECT user_id, event_type, median(value) AS med FROM events GROUP BY ALL)
SELECT user_id, event_type, count(*) AS n, round(any_value(med), 6) AS med, round(1.4826 * median(abs(value - med)), 6) AS noise
FROM events JOIN m USING (user_id, event_type) GROUP BY user_id, event_type""",
)
def robust_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    keys = ["user_id", "event_type"]
    out = Q.robust_noise(rows, keys, F.col("value")).join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    return out.select(*keys, "n", F.round("med", 6).alias("med"), F.round("noise", 6).alias("noise"))


@query(
    "direction_histogram",
    f"""
WITH e AS (SELECT event_type, least(CAST(floor({AZ_SQL} / 5) AS INTEGER), 71) AS bin FROM events)
SELECT event_type, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY event_type) * radians(5.0)), 6) AS density FROM e GROUP BY event_type, bin""",
)
def direction_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = H.circular_counts(table(spark, sf_dir, "events").select("event_type", azimuth().alias("az")), ["event_type"], F.col("az"), 72)
    # 72 rows a type at most.
    total = F.sum("n").over(W.partitionBy("event_type"))
    return counts.withColumn("density", F.round(F.col("n") / (total * F.radians(F.lit(5.0))), 6))


@query(
    "moving_mean",
    """
WITH e AS (SELECT user_id, event_id, value, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) AS n,
  sum(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s,
  first_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a,
  last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round((s + a * greatest(4 - r, 0) + b * greatest(3 + r - n, 0)) / 7, 6) AS smooth FROM e""",
)
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return rows.select("user_id", "event_id", F.round(S.edge_mean(F.col("value"), 7, ["user_id"], ["ts", "event_id"]), 6).alias("smooth"))


@query(
    "circular_smooth",
    f"""
WITH t AS (SELECT user_id, event_id, ts, sin(radians({AZ_SQL})) AS x, cos(radians({AZ_SQL})) AS y FROM events),
e AS (SELECT user_id, event_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) AS n,
  sum(x) OVER m AS sx, sum(y) OVER m AS sy, first_value(x) OVER z AS ax, last_value(x) OVER z AS bx, first_value(y) OVER z AS ay, last_value(y) OVER z AS by_
  FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
    m AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING),
    z AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT user_id, event_id, degrees(atan2((sx + ax * greatest(5 - r, 0) + bx * greatest(4 + r - n, 0)) / 9, (sy + ay * greatest(5 - r, 0) + by_ * greatest(4 + r - n, 0)) / 9)) AS g FROM e)
SELECT user_id, event_id, round(((g % 360) + 360) % 360, 4) AS smooth FROM d""",
)
def circular_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", azimuth().alias("az"))
    return rows.select("user_id", "event_id", F.round(S.edge_circular_mean(F.col("az"), 9, ["user_id"], ["ts", "event_id"]), 4).alias("smooth"))


@query(
    "moving_median",
    """
WITH e AS (SELECT user_id, event_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) AS n,
  list(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, event_id, list_sort(list_concat(list_concat([l[1] FOR i IN range(greatest(4 - r, 0))], l), [l[-1] FOR i IN range(greatest(3 + r - n, 0))])) AS q FROM e)
SELECT user_id, event_id, q[4] AS smooth FROM p""",
)
def moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return rows.select("user_id", "event_id", S.edge_median(F.col("value"), 7, ["user_id"], ["ts", "event_id"]).alias("smooth"))


@query(
    "gap_fill",
    f"""
WITH h AS ({HOURLY_SQL}),
g AS (SELECT event_type, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY event_type),
j AS (SELECT g.event_type, g.hour, h.level FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.hour = h.hour),
k AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN {{'x': hour, 'y': level}} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY hour ROWS UNBOUNDED PRECEDING) AS p,
  first_value(CASE WHEN level IS NOT NULL THEN {{'x': hour, 'y': level}} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM j)
SELECT event_type, hour, level IS NULL AS was_gap, round(p.y + coalesce((hour - p.x) / nullif(q.x - p.x, 0), 0) * (q.y - p.y), 6) AS filled FROM k""",
)
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir).select("event_type", "hour", "level")
    grid = h.groupBy("event_type").agg(F.explode(F.sequence(F.min("hour"), F.max("hour"))).alias("hour"))
    filled = S.fill_linear(grid.join(h, ["event_type", "hour"], "left"), "hour", "level", ["event_type"])
    return filled.select("event_type", "hour", F.col("level").isNull().alias("was_gap"), F.round("filled", 6).alias("filled"))


@query(
    "sustained_crossing",
    """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events),
w AS (SELECT user_id, us, bool_and(value > 5) OVER r AND count(*) OVER r >= 2 AS ok FROM e
  WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING))
SELECT user_id, min(CASE WHEN ok THEN us END) AS first_at FROM w GROUP BY user_id""",
)
def sustained_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("us"), "value")
    return S.first_sustained(rows, "value", 5, "us", 86_400_000_000, ["user_id"], "above")


@query(
    "longest_valid_run",
    """
WITH e AS (SELECT user_id, event_id, value, lag(value) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
o AS (SELECT *, value <= 150 AND (coalesce(p, 0) = 0 OR abs(value - p) <= 3 * p) AS ok FROM e),
i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM o),
r AS (SELECT user_id, island, count(*) AS run_rows, min(event_id) AS run_start, max(event_id) AS run_stop FROM i WHERE ok GROUP BY ALL)
SELECT user_id, run_start, run_stop, run_rows FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY run_rows DESC, island) = 1""",
)
def longest_valid_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", before.alias("p"))
    ok = (F.col("value") <= 150) & ((F.coalesce("p", F.lit(0.0)) == 0) | (F.abs(F.col("value") - F.col("p")) <= 3 * F.col("p")))
    return S.longest_run(rows, ok, ["user_id"], ["event_id"])


ROWS_SQL = f"WITH h AS ({HOURLY_SQL}), s AS (SELECT event_type, hour, n, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS r FROM h)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("event_type", "hour", "n", F.row_number().over(W.partitionBy("event_type").orderBy("hour")).alias("r"))


@query(
    "episodes",
    ROWS_SQL + """,
c AS (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY event_type ORDER BY r) > 5 THEN 1 ELSE 0 END AS f FROM s WHERE n > 4),
i AS (SELECT *, sum(f) OVER (PARTITION BY event_type ORDER BY r ROWS UNBOUNDED PRECEDING) AS id FROM c),
e AS (SELECT event_type, id, min(r) AS first_row, max(r) AS last_row, max(n) AS peak FROM i GROUP BY ALL)
SELECT e.event_type, first_row, last_row, peak, CAST(sum(s.n - 4) AS DOUBLE) AS strength FROM e JOIN s ON s.event_type = e.event_type AND s.r BETWEEN first_row AND last_row
WHERE last_row - first_row >= 2 OR peak > 8 GROUP BY ALL""",
)
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.episodes(numbered(spark, sf_dir), "r", "n", 4, 5, ["event_type"])
    return found.withColumn("strength", F.col("strength").cast("double"))


@query(
    "quiet_window",
    ROWS_SQL + """,
m AS (SELECT event_type, r, max(n) OVER w AS hi, count(*) OVER w AS k FROM s WINDOW w AS (PARTITION BY event_type ORDER BY r ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
SELECT event_type, coalesce(max(r) FILTER (hi <= 3), arg_min(r, {'a': hi, 'b': r})) AS start_row, max(r) FILTER (hi <= 3) IS NOT NULL AS is_calm FROM m WHERE k = 6 GROUP BY event_type""",
)
def quiet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quiet_window(numbered(spark, sf_dir), "r", "n", 6, 3, ["event_type"])


@query(
    "unwrap_gradient",
    f"""
WITH t AS (SELECT user_id, event_id, {AZ_SQL} AS az FROM events),
d AS (SELECT user_id, event_id, first_value(az) OVER w AS a, coalesce(((az - lag(az) OVER w + 180) % 360 + 360) % 360 - 180, 0) AS step FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
u AS (SELECT user_id, event_id, a + sum(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS unwrapped FROM d)
SELECT user_id, event_id, round(unwrapped, 4) AS unwrapped,
  round(coalesce((lead(unwrapped) OVER w - lag(unwrapped) OVER w) / 2, lead(unwrapped) OVER w - unwrapped, unwrapped - lag(unwrapped) OVER w), 4) + 0.0::DOUBLE AS rate
FROM u WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def unwrap_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", azimuth().alias("az"))
    rows = S.unwrap(rows, "az", ["user_id"], ["event_id"])
    return rows.select("user_id", "event_id", F.round("unwrapped", 4).alias("unwrapped"), (F.round(S.gradient("unwrapped", ["user_id"], ["event_id"]), 4) + 0.0).alias("rate"))


@query(
    "trajectory",
    f"""
WITH t AS (SELECT user_id, event_id, value * sin(radians({AZ_SQL})) AS e, value * cos(radians({AZ_SQL})) AS n FROM events)
SELECT user_id, event_id, round(sum(e) OVER w - first_value(e) OVER w, 4) + 0.0::DOUBLE AS east, round(sum(n) OVER w - first_value(n) OVER w, 4) + 0.0::DOUBLE AS north FROM t
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value", azimuth().alias("az"))
    path = lambda c: F.round(S.running_path(F.col("value") * c, ["user_id"], ["event_id"]), 4) + 0.0
    return rows.select("user_id", "event_id", path(C.sin_deg(F.col("az"))).alias("east"), path(C.cos_deg(F.col("az"))).alias("north"))


@query(
    "local_maxima",
    ROWS_SQL + """
SELECT event_type, hour, n FROM s WINDOW w AS (PARTITION BY event_type ORDER BY r) QUALIFY n > lag(n, 1) OVER w AND n > lag(n, 2) OVER w AND n > lead(n, 1) OVER w AND n > lead(n, 2) OVER w""",
)
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    return rows.withColumn("_top", S.local_maxima("n", 2, ["event_type"], ["r"])).filter("_top").select("event_type", "hour", "n")


@query(
    "even_rows",
    """
WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS m FROM events)
SELECT user_id, event_id FROM s WHERE m <= 9 OR r IN (SELECT round_even(i * (m - 1) / 8.0, 0) FROM range(9) t(i))""",
)
def even_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.even_rows(table(spark, sf_dir, "events").select("user_id", "event_id"), 9, ["user_id"], ["event_id"])


@query(
    "direction_modes",
    f"""
WITH e AS (SELECT event_type, least(CAST(floor({AZ_SQL} / 10) AS INTEGER), 35) AS bin FROM events),
g AS (SELECT t.event_type, b.bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM e) t CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(36)) b
  LEFT JOIN (SELECT event_type, bin, count(*) AS n FROM e GROUP BY ALL) c ON c.event_type = t.event_type AND c.bin = b.bin),
m AS (SELECT a.event_type, a.bin, a.n, l.n AS ln, r.n AS rn FROM g a JOIN g l ON l.event_type = a.event_type AND l.bin = (a.bin + 35) % 36 JOIN g r ON r.event_type = a.event_type AND r.bin = (a.bin + 1) % 36)
SELECT event_type, bin, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) AS mode FROM m WHERE n > ln AND n >= rn QUALIFY mode <= 2""",
)
def direction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.circular_modes(table(spark, sf_dir, "events").select("event_type", azimuth().alias("az")), ["event_type"], F.col("az"), 36, 2)
