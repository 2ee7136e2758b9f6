"""Wind from flow and stations: directions, windows of valid rows, interpolation, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions import circular as C
from skyplume.functions import physics as P
from skyplume.functions.guards import finite
from skyplume.functions.times import micros
from skyplume.jobs.join_jobs import HOUR
from skyplume.jobs.registry import query, table
from skyplume.jobs.series_jobs import AZ_SQL, HOURLY_SQL, azimuth, hourly
from skyplume.operators import fits, joins, quantiles, sampling, series

#: Weak values are lost: the sensor reports NaN.
LOST_SQL = "SELECT event_id, user_id, event_type, ts, CASE WHEN value < 5 THEN 'nan'::DOUBLE ELSE value END AS value FROM events"


def with_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return e.withColumn("value", F.when(F.col("value") < 5, F.lit(float("nan"))).otherwise(F.col("value")))


@query(
    "finite_statistics",
    f"""
WITH e AS (SELECT event_type, value, {AZ_SQL} AS az FROM ({LOST_SQL}) WHERE NOT isnan(value))
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(median(value), 6) AS middle, round(quantile_cont(value, 0.9), 6) AS p90,
  round(((degrees(atan2(sum(sin(radians(az))), sum(cos(radians(az))))) % 360) + 360) % 360, 6) AS direction FROM e GROUP BY 1""",
)
def finite_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates over what was measured; NaN in a quarter of the rows."""
    rows = with_losses(spark, sf_dir).withColumn("az", azimuth())
    value = finite(F.col("value"))
    means = rows.groupBy("event_type").agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(C.circular_mean(F.col("az")), 6).alias("direction"))
    q = quantiles.quantiles(rows, ["event_type"], F.col("value"), [0.1, 0.5, 0.9], ["p10", "middle", "p90"])
    return means.join(q.select("event_type", *[F.round(c, 6).alias(c) for c in ("p10", "middle", "p90")]), "event_type")


@query(
    "weighted_spread",
    f"""
WITH e AS (SELECT user_id, value AS w, {AZ_SQL} AS az FROM ({LOST_SQL}) WHERE NOT isnan(value))
SELECT user_id, round(degrees(sqrt(greatest(-2 * ln(greatest(sqrt(pow(sum(w * sin(radians(az))), 2) + pow(sum(w * cos(radians(az))), 2)) / sum(w), 1e-12)), 0))), 6) AS spread FROM e GROUP BY 1""",
)
def weighted_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_losses(spark, sf_dir).groupBy("user_id").agg(F.round(C.circular_spread(azimuth(), F.col("value")), 6).alias("spread"))


@query(
    "von_mises_fit",
    f"""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, radians({AZ_SQL}) AS a FROM events WHERE value > 20),
m AS (SELECT user_id, day, count(*) AS n, avg(cos(a)) AS c, avg(sin(a)) AS s FROM e GROUP BY ALL),
r AS (SELECT *, least(sqrt(c * c + s * s), 1 - 1e-12) AS r FROM m)
SELECT user_id, day, CASE WHEN n >= 3 THEN round(degrees(atan2(s, c)), 6) END AS mu, CASE WHEN n >= 3 THEN round(r * (2 - r * r) / (1 - r * r), 5) END AS kappa, CASE WHEN n >= 3 THEN round(r, 6) END AS resultant FROM r""",
)
def von_mises_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of each user's day, weak vectors left out."""
    rows = table(spark, sf_dir, "events").filter("value > 20")
    mu, kappa, r = C.von_mises(azimuth(), F.col("value") > 0, 3)
    return rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(mu, 6).alias("mu"), F.round(kappa, 5).alias("kappa"), F.round(r, 6).alias("resultant"))


@query(
    "pooled_directions",
    f"""
WITH e AS (SELECT event_type, {AZ_SQL} AS a FROM events),
f AS (SELECT event_type, avg(cos(radians(a))) AS c, avg(sin(radians(a))) AS s FROM e GROUP BY 1),
g AS (SELECT event_type, degrees(atan2(s, c)) AS mu, sqrt(c * c + s * s) AS r FROM f),
d AS (SELECT event_type, ((a - mu + 180) % 360 + 360) % 360 - 180 AS d FROM e JOIN g USING (event_type)),
q AS (SELECT event_type, quantile_cont(d, 0.05) AS low, quantile_cont(d, 0.95) AS high FROM d GROUP BY 1)
SELECT event_type, round(mu, 5) AS mu, round(r * (2 - r * r) / (1 - r * r), 6) AS kappa, round(low, 4) AS low, round(high, 4) AS high, round(degrees(1 / sqrt(r * (2 - r * r) / (1 - r * r))), 4) AS sigma FROM g JOIN q USING (event_type)""",
)
def pooled_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fits.pooled_spread(table(spark, sf_dir, "events").select("event_type", azimuth().alias("az")), ["event_type"], F.col("az"))
    return rows.select("event_type", F.round("mu", 5).alias("mu"), F.round("kappa", 6).alias("kappa"), *[F.round(c, 4).alias(c) for c in ("low", "high", "sigma")])


@query(
    "sustained_since",
    f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, value, NOT isnan(value) AND value < 40 AS ok FROM ({LOST_SQL})),
w AS (SELECT user_id, us, value, bool_and(ok) OVER r AND count(*) OVER r >= 2 AND NOT isnan(value) AS ok FROM e
  WINDOW r AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 86400000000 FOLLOWING))
SELECT user_id, min(CASE WHEN ok AND us >= epoch_us(TIMESTAMP '2024-01-05') THEN us END) AS first_at FROM w GROUP BY user_id""",
)
def sustained_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first instant after a date from which the level stays low for a day; lost values are not low."""
    rows = with_losses(spark, sf_dir).select("user_id", micros("ts").alias("us"), "value")
    return series.first_sustained(rows, "value", 40, "us", 86_400_000_000, ["user_id"], since=F.lit(1_704_412_800_000_000))


@query(
    "drift_rate",
    f"""
WITH t AS (SELECT user_id, event_id, epoch_us(ts) / 3600000000.0 AS h, {AZ_SQL} AS az FROM events),
d AS (SELECT user_id, event_id, h, first_value(az) OVER w AS a, coalesce(((az - lag(az) OVER w + 180) % 360 + 360) % 360 - 180, 0) AS step FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
u AS (SELECT user_id, event_id, h, a + sum(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x FROM d),
g AS (SELECT user_id, event_id, coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w) AS dx, coalesce((lead(h) OVER w - lag(h) OVER w) / 2, lead(h) OVER w - h, h - lag(h) OVER w) AS dh
  FROM u WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(dx / nullif(dh, 0), 4) + 0.0::DOUBLE AS rate FROM g""",
)
def drift_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees an hour of the followed direction."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (micros("ts") / 3600000000.0).alias("h"), azimuth().alias("az"))
    rows = series.unwrap(rows, "az", ["user_id"], ["event_id"])
    return rows.select("user_id", "event_id", (F.round(series.rate("unwrapped", "h", ["user_id"], ["event_id"]), 4) + 0.0).alias("rate"))


@query(
    "short_moving_mean",
    """
WITH l AS (SELECT user_id, CAST(ts AS DATE) AS day, list(value ORDER BY ts, event_id) AS v, list(event_id ORDER BY ts, event_id) AS e FROM events GROUP BY ALL),
r AS (SELECT user_id, day, v, e, unnest(range(1, len(v) + 1)) AS i, len(v) AS n, least(7, len(v)) AS w FROM l)
SELECT user_id, e[i] AS event_id, round(list_sum(list_transform(range(w), lambda k: v[greatest(least(i + k - w // 2, n), 1)])) / w, 6) AS smooth FROM r""",
)
def short_moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series shorter than the window: a user's day."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), "value")
    return rows.select("user_id", "event_id", F.round(series.edge_mean(F.col("value"), 7, ["user_id", "day"], ["ts", "event_id"]), 6).alias("smooth"))


@query(
    "frame_repeats",
    """
SELECT l_suppkey, frame, greatest(CAST(round_even(gap / 25.0 / 2.0 * 30.0, 0) AS BIGINT), 1) AS times FROM (
  SELECT l_suppkey, frame, coalesce(lead(frame) OVER w - frame, frame - lag(frame) OVER w, 1) AS gap FROM (SELECT DISTINCT l_suppkey, l_orderkey AS frame FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey ORDER BY frame))""",
)
def frame_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("frame")).distinct()
    return rows.select("l_suppkey", "frame", series.repeats("frame", ["l_suppkey"], 25, 30, 2.0).alias("times"))


@query(
    "discard_reasons",
    """
WITH s AS (SELECT l_suppkey, l_orderkey AS frame, sum(l_quantity) AS px, bool_and(l_discount < 0.08) AS ok FROM lineitem GROUP BY ALL),
g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY l_suppkey ORDER BY frame) AS gap FROM s),
r AS (SELECT l_suppkey, CASE WHEN gap > 40 THEN 'gap' WHEN NOT ok THEN 'unreadable' WHEN px <= 15 THEN 'few pixels' ELSE 'ok' END AS reason FROM g WHERE gap IS NOT NULL)
SELECT l_suppkey, reason, count(*) AS n FROM r GROUP BY ALL""",
)
def discard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_orderkey").alias("frame")).agg(F.sum("l_quantity").alias("px"), F.bool_and(F.col("l_discount") < 0.08).alias("ok"))
    return series.gap_reasons(rows, "frame", "px", F.col("ok"), 40, 15, ["l_suppkey"]).groupBy("l_suppkey", "reason").agg(F.count("*").alias("n"))


@query("first_solid", "WITH m AS (SELECT l_suppkey, max(l_extendedprice) AS top FROM lineitem GROUP BY 1) SELECT l_suppkey, min(l_orderkey) AS first_index FROM lineitem JOIN m USING (l_suppkey) WHERE l_extendedprice >= 0.5 * top GROUP BY 1")
def first_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame with half of the largest area."""
    return series.first_reaching(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_extendedprice"), "l_orderkey", "l_extendedprice", 0.5, ["l_suppkey"])


GRID_SQL = f"""
WITH h AS ({HOURLY_SQL}), b AS (SELECT min(hour) - 3 AS lo, max(hour) + 3 AS hi FROM h),
g AS (SELECT event_type, unnest(range(lo, hi + 1)) - lo AS t, unnest(range(lo, hi + 1)) AS hour FROM (SELECT DISTINCT event_type FROM h) CROSS JOIN b),
j AS (SELECT g.event_type, g.t, h.level FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.hour = h.hour),
k AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN {{'x': t, 'y': level}} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS p,
  first_value(CASE WHEN level IS NOT NULL THEN {{'x': t, 'y': level}} END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM j),
f AS (SELECT event_type, regr_slope(ln(level), ln(t + 1)) AS b, regr_intercept(ln(level), ln(t + 1)) AS a FROM j WHERE level > 0 AND t > 0 GROUP BY 1)"""


@query("held_ends", GRID_SQL + " SELECT event_type, t, round(CASE WHEN p IS NULL THEN exp(a + b * ln(t + 1)) WHEN q IS NULL THEN p.y ELSE p.y + coalesce((t - p.x) / nullif(q.x - p.x, 0), 0) * (q.y - p.y) END, 6) AS estimate FROM k JOIN f USING (event_type)")
def held_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels on every hour, from three before the first to three after the last."""
    h = hourly(spark, sf_dir).select("event_type", "hour", "level")
    ends = h.agg((F.min("hour") - 3).alias("lo"), (F.max("hour") + 3).alias("hi"))
    grid = h.select("event_type").distinct().join(F.broadcast(ends)).select("event_type", F.explode(F.sequence("lo", "hi")).alias("hour"), "lo")
    rows = grid.join(h, ["event_type", "hour"], "left").select("event_type", (F.col("hour") - F.col("lo")).alias("t"), "level")
    return series.held_ends(rows, "t", "level", ["event_type"]).select("event_type", "t", F.round("estimate", 6).alias("estimate"))


@query(
    "drift_speed",
    """
WITH e AS (SELECT l_suppkey AS cloud, l_orderkey * 10 + l_linenumber AS t, l_quantity AS x, l_extendedprice / 1000 AS y, l_partkey FROM lineitem),
d AS (SELECT cloud, t, arg_min({'x': x, 'y': y}, l_partkey) AS p FROM e GROUP BY ALL),
s AS (SELECT cloud, arg_max(p, t) AS b, arg_min(p, t) AS a, max(t) - min(t) AS dt, max(p.x) - min(p.x) AS ex, max(p.y) - min(p.y) AS ey FROM d GROUP BY 1)
SELECT cloud, round(sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) / nullif(dt, 0), 9) AS speed, round(((degrees(atan2(b.x - a.x, b.y - a.y)) % 360) + 360) % 360, 6) AS azimuth, round(ex, 6) AS extent_x, round(ey, 6) AS extent_y FROM s""",
)
def drift_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cloud"), t).agg(F.min_by("l_quantity", "l_partkey").alias("x"), (F.min_by("l_extendedprice", "l_partkey") / 1000).alias("y"))
    out = series.drift(rows, "t", "x", "y", ["cloud"])
    return out.select("cloud", F.round("speed", 9).alias("speed"), F.round("azimuth", 6).alias("azimuth"), F.round("extent_x", 6).alias("extent_x"), F.round("extent_y", 6).alias("extent_y"))


@query(
    "plateau_height",
    """
WITH f AS (SELECT l_suppkey AS cloud, l_orderkey // 50 AS t, sum(l_quantity) AS v, avg(l_extendedprice) / 1000 AS h FROM lineitem GROUP BY ALL),
o AS (SELECT *, v >= 0.6 * max(v) OVER (PARTITION BY cloud) AS big FROM f),
p AS (SELECT * FROM o QUALIFY big OR count(*) FILTER (big) OVER (PARTITION BY cloud) < 3),
q AS (SELECT *, min(CASE WHEN h >= 0.9 * top THEN t END) OVER (PARTITION BY cloud) AS since FROM (SELECT *, max(h) OVER (PARTITION BY cloud) AS top FROM p))
SELECT cloud, round(median(h) + 1e-9::DOUBLE, 6) AS plateau, min(t) AS since, count(*) AS n_rows, round(min(h) + 1e-9::DOUBLE, 6) AS lowest, round(max(h) + 1e-9::DOUBLE, 6) AS highest FROM q WHERE t >= since GROUP BY 1""",
)
def plateau_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cloud"), F.expr("l_orderkey div 50").alias("t")).agg(F.sum("l_quantity").alias("v"), (F.avg("l_extendedprice") / 1000).alias("h"))
    out = series.plateau(rows, "t", "h", "v", ["cloud"])
    # A hair above, so that halves round the same way everywhere.
    up = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return out.select("cloud", up("plateau"), "since", "n_rows", up("lowest"), up("highest"))


@query("replica_band", f"SELECT user_id, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS hour, min(value) AS low, max(value) AS high, count(*) AS replicas FROM ({LOST_SQL}) WHERE NOT isnan(value) GROUP BY ALL")
def replica_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_losses(spark, sf_dir).select("user_id", F.floor(micros("ts") / 3600000000.0).alias("hour"), "value")
    return series.band(rows, ["user_id", "hour"], "value").filter("replicas > 0")


@query(
    "flow_speed",
    """
WITH e AS (SELECT l_suppkey AS pair, l_quantity - 20 AS fx, l_extendedprice / 1000 - 25 AS fy, l_suppkey % 3 + 1 AS gap FROM lineitem),
s AS (SELECT pair, any_value(gap) AS gap, avg(fx) AS mx, avg(fy) AS my, var_samp(fx) AS sxx, var_samp(fy) AS syy, covar_samp(fx, fy) AS sxy FROM e GROUP BY 1),
a AS (SELECT pair, gap, mx, my, 0.5 * atan2(2 * sxy, sxx - syy) AS g FROM s),
x AS (SELECT pair, gap, CASE WHEN cos(g) * mx + sin(g) * my < 0 THEN -cos(g) ELSE cos(g) END AS ax, CASE WHEN cos(g) * mx + sin(g) * my < 0 THEN -sin(g) ELSE sin(g) END AS ay FROM a)
SELECT pair, round(any_value(ax), 6) AS ax, round(any_value(ay), 6) AS ay, round(median(fx * ax + fy * ay) / any_value(x.gap), 6) AS speed FROM e JOIN x USING (pair) GROUP BY 1""",
)
def flow_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median flow along each field's own axis, a frame."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pair"), (F.col("l_quantity") - 20).alias("fx"), (F.col("l_extendedprice") / 1000 - 25).alias("fy"))
    out = fits.projected_speed(rows, ["pair"], "fx", "fy", F.col("pair") % 3 + 1)
    return out.select("pair", *[F.round(c, 6).alias(c) for c in ("ax", "ay", "speed")])


@query(
    "log_log_fit",
    """
WITH d AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_quantity AS t, var_pop(l_extendedprice / 1000) AS s2 FROM lineitem GROUP BY ALL)
SELECT flag, status, round(regr_slope(ln(s2), ln(t)), 6) AS alpha, round(exp(regr_intercept(ln(s2), ln(t))), 6) AS k, round(regr_r2(ln(s2), ln(t)), 6) AS r2, count(*) AS n FROM d WHERE s2 > 0 AND t > 0 GROUP BY ALL""",
)
def log_log_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("t")).agg(F.var_pop(F.col("l_extendedprice") / 1000).alias("s2"))
    out = fits.log_log(rows, ["flag", "status"], "t", "s2")
    return out.select("flag", "status", *[F.round(c, 6).alias(c) for c in ("alpha", "k", "r2")], F.col("n").cast("long").alias("n"))


@query(
    "growth_curve",
    """
SELECT p_partkey, round(sqrt(greatest(CASE WHEN t <= 20 THEN s0 + k * pow(t, alpha) ELSE s0 + k * pow(20, alpha) + k * alpha * pow(20, alpha - 1) * (t - 20) END, 1e-6)), 6) AS sigma
FROM (SELECT p_partkey, p_size::DOUBLE AS t, p_retailprice / 100 AS s0, p_partkey % 7 + 0.5 AS k, 0.5::DOUBLE + (p_partkey % 20) / 10.0 AS alpha FROM part)""",
)
def growth_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growth law inside and beyond its measured span."""
    p = F.col("p_partkey")
    sigma = P.grown_sigma(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, p % 7 + 0.5, 0.5 + (p % 20) / 10, F.lit(20.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sigma, 6).alias("sigma"))


@query(
    "radial_rings",
    """
WITH p AS (SELECT l_suppkey AS cloud, l_quantity - 25 AS x, l_linenumber * 5.0 - 20 AS y FROM lineitem),
g AS (SELECT least(greatest(CAST(floor(sqrt(a.x * a.x + b.y * b.y) / 40 * 8) AS INTEGER), 0), 7) AS ring FROM (SELECT unnest(range(-25, 26)) AS x) a, (SELECT unnest(range(-20, 21)) AS y) b),
w AS (SELECT ring, count(*) AS pixels FROM g GROUP BY 1),
r AS (SELECT cloud, least(greatest(CAST(floor(sqrt(x * x + y * y) / 40 * 8) AS INTEGER), 0), 7) AS ring, count(*) AS n FROM p GROUP BY ALL)
SELECT cloud, ring, n, round(n / greatest(pixels, 1), 6) AS share, n / greatest(pixels, 1) >= 1.5 * greatest(sum(n) OVER (PARTITION BY cloud) / (SELECT sum(pixels) FROM w), 1e-6) AS bright FROM r JOIN w USING (ring)""",
)
def radial_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cloud"), (F.col("l_quantity") - 25).alias("x"), (F.col("l_linenumber") * 5.0 - 20).alias("y"))
    side = lambda n: F.sequence(F.lit(-n), F.lit(n))
    # The frame's own pixels, whatever the data.
    frame = spark.range(1).select(F.explode(side(25)).alias("x")).select("x", F.explode(side(20)).alias("y"))
    ring = F.least(F.floor(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 40 * 8).cast("int"), F.lit(7))
    population = frame.groupBy(ring.alias("ring")).agg(F.count("*").alias("pixels"))
    out = fits.radial_rings(rows, ["cloud"], F.col("x"), F.col("y"), 8, 40.0, population, 1.5)
    return out.withColumn("share", F.round("share", 6))


@query(
    "level_radii",
    """
WITH p AS (SELECT l_suppkey AS cloud, CAST(floor(l_quantity / 10) AS INTEGER) AS k, l_extendedprice / 1000 AS x, l_discount * 100 AS y FROM lineitem),
g AS (SELECT cloud, k, min(x) AS a0, max(x) AS a1, min(0.6::DOUBLE * x + 0.8::DOUBLE * y) AS b0, max(0.6::DOUBLE * x + 0.8::DOUBLE * y) AS b1 FROM p GROUP BY ALL HAVING count(*) >= 3)
SELECT cloud, k, round(0.5 * least(a1 - a0, b1 - b0) + 1e-9::DOUBLE, 6) AS radius, round((a0 + a1) / 2 + 1e-9::DOUBLE, 6) AS x, round(((b0 + b1) / 2 - 0.6::DOUBLE * (a0 + a1) / 2) / 0.8::DOUBLE + 1e-9::DOUBLE, 6) AS y FROM g""",
)
def level_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cloud"), F.floor(F.col("l_quantity") / 10).cast("int").alias("k"), (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_discount") * 100).alias("y"))
    out = fits.level_radii(rows, ["cloud"], "k", "x", "y", (1.0, 0.0), (0.6, 0.8))
    return out.select("cloud", "k", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("radius", "x", "y")])


@query("time_axis", "SELECT event_id, round((event_id - 120) / 29.97::DOUBLE, 6) AS t FROM events WHERE round((event_id - 120) / 29.97::DOUBLE, 6) BETWEEN 0 AND 60")
def time_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from the pivot frame, within a window."""
    t = F.round((F.col("event_id") - 120) / 29.97, 6)
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).filter(F.col("t").between(0, 60))


@query(
    "wind_at",
    f"""
WITH e AS (SELECT event_type, CAST(floor(epoch_us(ts) / {HOUR}.0) AS BIGINT) * {HOUR} AS t, value, {AZ_SQL} AS az FROM events WHERE event_type IN ('view', 'click')),
s AS (SELECT event_type AS station, t, avg(value) AS v, ((degrees(atan2(sum(sin(radians(az))), sum(cos(radians(az))))) % 360) + 360) % 360 AS d FROM e GROUP BY ALL),
q AS (SELECT event_id, CASE WHEN value > 30 THEN 'view' WHEN value > 10 THEN 'click' ELSE 'signup' END AS station, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
p AS (SELECT q.*, s.t, s.v, s.d FROM q ASOF LEFT JOIN s ON q.station = s.station AND q.us > s.t),
b AS (SELECT p.*, n.t AS nt, n.v AS nv, n.d AS nd FROM p ASOF LEFT JOIN s n ON p.station = n.station AND p.us <= n.t),
c AS (SELECT *, station IN (SELECT station FROM s) AS known, (us - t) / (nt - t) AS w FROM b),
f AS (SELECT *, CASE WHEN NOT known THEN 'none' WHEN t IS NULL THEN 'before' WHEN nt IS NULL THEN 'after' WHEN nt - t <= {2 * HOUR} THEN 'ok' ELSE 'gap' END AS status FROM c)
SELECT event_id, status, CASE WHEN status = 'ok' THEN round(v + w * (nv - v), 6) END AS speed,
  CASE WHEN status = 'ok' THEN round(((degrees(atan2((1 - w) * sin(radians(d)) + w * sin(radians(nd)), (1 - w) * cos(radians(d)) + w * cos(radians(nd)))) % 360) + 360) % 360, 5) END AS direction FROM f""",
)
def wind_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed and direction of a station at an instant, or why there is none."""
    e = table(spark, sf_dir, "events").filter("event_type in ('view', 'click')").select(F.col("event_type").alias("station"), (F.floor(micros("ts") / float(HOUR)) * HOUR).alias("t"), "value", azimuth().alias("az"))
    stations = e.groupBy("station", "t").agg(F.avg("value").alias("v"), C.circular_mean(F.col("az")).alias("d"))
    which = F.when(F.col("value") > 30, "view").when(F.col("value") > 10, "click").otherwise("signup")
    asked = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", which.alias("station"), micros("ts").alias("us"))
    rows = joins.bracketed(asked, "event_id", "us", stations, "t", "v", 2 * HOUR, ["station"], "d")
    return rows.select("event_id", "status", F.round("interpolated", 6).alias("speed"), F.round("direction", 5).alias("direction"))


INSTANTS = (1_704_153_600_000_000, 1_704_844_800_000_000, 1_700_000_000_000_000)


@query(
    "coverage_by_margin",
    f"""
WITH s AS (SELECT user_id, epoch_us(ts) AS t FROM events), i AS (SELECT unnest([{", ".join(map(str, INSTANTS))}]) AS instant),
c AS (SELECT user_id, instant, min(t) AS a, max(t) AS b, count(*) FILTER (abs(t - instant) <= {6 * HOUR}) AS n_near, min(abs(t - instant)) AS d FROM s, i GROUP BY ALL),
v AS (SELECT *, CASE WHEN instant < a THEN 'before' WHEN instant > b THEN 'after' WHEN n_near = 0 THEN 'hole' WHEN n_near < 6 THEN 'partial' ELSE 'full' END AS verdict FROM c)
SELECT user_id, instant, verdict, n_near, CASE WHEN verdict IN ('partial', 'full') THEN d END AS nearest FROM v""",
)
def coverage_by_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's series covers some instants with six hours to either side."""
    return joins.coverage(table(spark, sf_dir, "events").select("user_id", micros("ts").alias("t")), ["user_id"], "t", list(INSTANTS), 6 * HOUR, 6)


@query("confident_keyframes", """
WITH m AS (SELECT user_id, event_id, CASE WHEN value > 25 THEN 'carved' WHEN value > 12 THEN 'no shadow' END AS mode FROM events WHERE event_type <> 'view'),
r AS (SELECT e.user_id, e.event_id, coalesce(m.mode <> 'no shadow', false) AS sure FROM events e LEFT JOIN m ON e.event_id = m.event_id)
SELECT user_id, event_id FROM r QUALIFY sure OR NOT bool_or(sure) OVER (PARTITION BY user_id)""")  # fmt: skip
def confident_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    modes = e.filter("event_type <> 'view'").select("event_id", F.when(F.col("value") > 25, "carved").when(F.col("value") > 12, "no shadow").alias("mode"))
    return joins.confident_or_all(e.select("user_id", "event_id"), "event_id", modes, "mode", "no shadow", ["user_id"])


@query("known_or_median", f"""
WITH k AS (SELECT event_id, value FROM ({LOST_SQL}) WHERE event_type <> 'error' AND NOT isnan(value)),
j AS (SELECT e.user_id, e.event_id, k.value FROM events e LEFT JOIN k ON e.event_id = k.event_id)
SELECT user_id, event_id, round(coalesce(value, median(value) OVER (PARTITION BY user_id)), 6) AS value FROM j""")  # fmt: skip
def known_or_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A height by frame, missing ones by the median."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    heights = with_losses(spark, sf_dir).filter("event_type <> 'error'").select("event_id", "value")
    return joins.known_or_median(e, "event_id", heights, "value", ["user_id"]).withColumn("value", F.round("value", 6))


@query("frame_times", f"""
SELECT e.event_id, round(coalesce(k.value, (e.event_id - 50.5) / 25), 6) AS t FROM events e LEFT JOIN (SELECT event_id, value FROM ({LOST_SQL}) WHERE NOT isnan(value) AND event_type = 'click') k ON e.event_id = k.event_id""")  # fmt: skip
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    times = with_losses(spark, sf_dir).filter("event_type = 'click'").select("event_id", "value")
    return joins.known_or_frame_time(e, "event_id", times.withColumnRenamed("value", "t"), "t", 50.5, 25).withColumn("t", F.round("t", 6))


@query("preferred_masks", "SELECT event_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, -value FROM events WHERE value > 10 AND event_type <> 'click'")
def preferred_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward rows override backward ones."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return joins.preferred(e.filter("event_type = 'click'").select("event_id", "value"), e.filter("value > 10").select("event_id", (-F.col("value")).alias("value")), ["event_id"])


@query("distinct_windows", "SELECT DISTINCT CAST(floor(value / 10) AS BIGINT) AS u0, CAST(floor(value / 10) AS BIGINT) + 4 AS u1, event_type FROM events")
def distinct_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo = F.floor(F.col("value") / 10)
    return joins.first_of_each(table(spark, sf_dir, "events").select(lo.alias("u0"), (lo + 4).alias("u1"), "event_type"), ["u0", "u1", "event_type"])


@query("sample_of_rows", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5('7/' || event_id), event_id) <= 20")
def sample_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample without replacement, up to 20 rows a user."""
    return sampling.without_replacement(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 20, 7)


@query("draws_of_rows", """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
d AS (SELECT user_id, CAST(unnest(range(25)) AS INTEGER) AS draw, n FROM n),
p AS (SELECT user_id, draw, CAST(('0x' || substr(md5('0/' || user_id || '/' || draw), 1, 8)) AS BIGINT) % n AS i FROM d)
SELECT p.user_id, p.draw, e.event_id FROM p JOIN e ON e.user_id = p.user_id AND e.i = p.i""")  # fmt: skip
def draws_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample with replacement, 25 draws a user."""
    return sampling.with_replacement(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 25)


@query("direction_density", f"""
WITH e AS (SELECT event_type, least(CAST(floor({AZ_SQL} / 5) AS INTEGER), 71) AS bin FROM events), c AS (SELECT event_type, bin, count(*) AS n FROM e GROUP BY ALL)
SELECT t.event_type, list(round(coalesce(n, 0) / t.total / radians(5.0), 6) ORDER BY b.bin)::VARCHAR AS density FROM (SELECT event_type, count(*) AS total FROM e GROUP BY 1) t CROSS JOIN (SELECT CAST(range AS INTEGER) AS bin FROM range(72)) b
LEFT JOIN c ON c.event_type = t.event_type AND c.bin = b.bin GROUP BY 1""")  # fmt: skip
def direction_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of 72 bins as one array a type, empty bins included."""
    from skyplume.operators.histograms import circular_density

    out = circular_density(table(spark, sf_dir, "events").select("event_type", azimuth().alias("az")), ["event_type"], F.col("az"), 72)
    return out.select("event_type", F.transform("density", lambda x: F.round(x, 6)).cast("string").alias("density"))
