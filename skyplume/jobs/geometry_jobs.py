"""Fits, moments, masks and voxels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions import physics as P
from skyplume.functions.times import micros
from skyplume.jobs.registry import query, table
from skyplume.operators import fits, masks, quantiles, reports

#: The first 64 components as an 8 x 8 frame of pixels.
PX_SQL = "SELECT vec_id AS frame, label, CAST((i - 1) // 8 AS INTEGER) AS v, CAST((i - 1) % 8 AS INTEGER) AS u, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i)"
ON_SQL = f"SELECT * FROM ({PX_SQL}) WHERE value > 0"


def on_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, F.col("value") > 0)


@query(
    "flow_axis",
    """
WITH s AS (SELECT label, count(*) AS n, avg(embedding[1]::DOUBLE) AS mx, avg(embedding[2]::DOUBLE) AS my, var_samp(embedding[1]::DOUBLE) AS sxx, var_samp(embedding[2]::DOUBLE) AS syy,
  covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS sxy FROM embeddings GROUP BY label),
a AS (SELECT *, 0.5 * atan2(2 * sxy, sxx - syy) AS g FROM s)
SELECT label, n, round(CASE WHEN cos(g) * mx + sin(g) * my < 0 THEN -cos(g) ELSE cos(g) END, 6) AS ax, round(CASE WHEN cos(g) * mx + sin(g) * my < 0 THEN -sin(g) ELSE sin(g) END, 6) AS ay FROM a""",
)
def flow_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal axis of a vector field, turned towards its mean."""
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    out = fits.principal_axis(table(spark, sf_dir, "embeddings").select("label", x.alias("x"), y.alias("y")), ["label"], "x", "y")
    return out.select("label", "n", F.round("ax", 6).alias("ax"), F.round("ay", 6).alias("ay"))


@query(
    "ols_fit",
    """
SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""",
)
def ols_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query(
    "growth_law",
    """
WITH d AS (SELECT l_returnflag AS flag, l_quantity AS t, var_pop(l_extendedprice / 1000) AS s2 FROM lineitem GROUP BY ALL),
g AS (SELECT flag, t, s2, 0.2::DOUBLE + i * 0.005::DOUBLE AS alpha, pow(t, 0.2::DOUBLE + i * 0.005::DOUBLE) AS x FROM d, range(561) r(i)),
f AS (SELECT flag, alpha, regr_slope(s2, x) AS k, regr_intercept(s2, x) AS s0, sum(x * s2) / sum(x * x) AS o FROM g GROUP BY ALL),
h AS (SELECT flag, alpha, CASE WHEN s0 < 0 THEN o ELSE k END AS k, CASE WHEN s0 < 0 THEN 0 ELSE s0 END AS s0 FROM f),
e AS (SELECT g.flag, g.alpha, any_value(h.k) AS k, any_value(h.s0) AS s0, sum(pow(g.s2 - h.s0 - h.k * g.x, 2)) AS sse FROM g JOIN h ON g.flag = h.flag AND g.alpha = h.alpha WHERE h.k > 0 GROUP BY ALL)
SELECT flag, round(alpha, 3) AS alpha, round(k, 4) AS k, round(s0, 4) AS s0, CASE WHEN alpha < 1.3 THEN 'fickian' WHEN alpha < 2.3 THEN 'superdiffusive' ELSE 'richardson' END AS regime
FROM e QUALIFY row_number() OVER (PARTITION BY flag ORDER BY sse, alpha) = 1""",
)
def growth_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("t")).agg(F.var_pop(F.col("l_extendedprice") / 1000).alias("s2"))
    best = fits.power_law(rows, ["flag"], "t", "s2")
    return best.select("flag", F.round("alpha", 3).alias("alpha"), F.round("k", 4).alias("k"), F.round("s0", 4).alias("s0"), P.regime(F.col("alpha")).alias("regime"))


@query(
    "puff_field",
    f"""
SELECT s_suppkey, i AS x, round((abs(s_acctbal) + 1) / ({(2 * math.pi) ** 1.5}::DOUBLE * 3.0 * 2.0 * 1.5) * exp(-((i - 4.0) * (i - 4.0)) / (2 * 3.0 * 3.0)) * exp(-(1.0 * 1.0) / (2 * 2.0 * 2.0))
  * (exp(-((2.0 - 5.0) * (2.0 - 5.0)) / (2 * 1.5 * 1.5)) + exp(-((2.0 + 5.0) * (2.0 + 5.0)) / (2 * 1.5 * 1.5))), 6) AS chi FROM supplier, range(10) t(i)""",
)
def puff_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("x"))
    lit = lambda v: F.lit(float(v))
    chi = P.puff(F.abs("s_acctbal") + 1, F.col("x") - 4.0, lit(1), lit(2), lit(5), lit(3), lit(2), lit(1.5))
    return rows.select("s_suppkey", F.col("x").cast("long").alias("x"), F.round(chi, 6).alias("chi"))


@query(
    "log_profile",
    f"SELECT event_id, round(value * ({math.log(25 / 0.1) / math.log(10 / 0.1)}::DOUBLE), 6) AS at_25m, round(331.3::DOUBLE * sqrt(1 + (value / 10) / 273.15::DOUBLE), 6) AS sound, "
    "round(1 / (1 + exp(least(greatest(-0.2::DOUBLE * (value - 30.0::DOUBLE), -60), 60))), 6) AS score FROM events",
)
def log_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(P.log_profile(v, 25, 10, 0.1), 6).alias("at_25m"), F.round(P.sound_speed(v / 10), 6).alias("sound"), F.round(P.sigmoid(v, 30.0, 0.2), 6).alias("score"))


@query(
    "solar_position",
    """
WITH t AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2000-01-01 12:00:00')) / 86400000000.0::DOUBLE AS d FROM events),
a AS (SELECT event_id, d, radians((357.529::DOUBLE + 0.98560028::DOUBLE * d) % 360) AS g, (280.459::DOUBLE + 0.98564736::DOUBLE * d) % 360 AS q, radians(23.439::DOUBLE - 0.00000036::DOUBLE * d) AS e FROM t),
b AS (SELECT event_id, d, e, radians((q + 1.915::DOUBLE * sin(g) + 0.020::DOUBLE * sin(2 * g)) % 360) AS l FROM a),
c AS (SELECT event_id, atan2(cos(e) * sin(l), cos(l)) AS ra, asin(sin(e) * sin(l)) AS de, (18.697374558::DOUBLE + 24.06570982441908::DOUBLE * d) % 24 AS gmst FROM b),
h AS (SELECT event_id, de, radians(((gmst * 15 - 70.5::DOUBLE) % 360 + 360) % 360) - ra AS h, radians(-33.4::DOUBLE) AS la FROM c)
SELECT event_id, round(((degrees(atan2(-cos(de) * sin(h), sin(de) * cos(la) - cos(de) * sin(la) * cos(h))) % 360) + 360) % 360, 5) AS azimuth, round(degrees(asin(sin(la) * sin(de) + cos(la) * cos(de) * cos(h))), 5) AS elevation FROM h""",
)
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sun at a place at the instant of each event."""
    days = (micros("ts") - 946_728_000_000_000) / 86_400_000_000.0
    azimuth, elevation = P.sun(days, -33.4, -70.5)
    return table(spark, sf_dir, "events").select("event_id", F.round(azimuth, 5).alias("azimuth"), F.round(elevation, 5).alias("elevation"))


@query(
    "weighted_moments",
    """
WITH p AS (SELECT p_brand, p_size::DOUBLE AS u, p_retailprice AS v, (p_partkey % 7 + 1)::DOUBLE AS w FROM part),
m AS (SELECT p_brand, sum(w) AS mass, sum(w * u) / sum(w) AS mean_u, sum(w * v) / sum(w) AS mean_v FROM p GROUP BY 1),
c AS (SELECT p_brand, mass, mean_u, mean_v, sum(w * pow(u - mean_u, 2)) / sum(w) AS a, sum(w * pow(v - mean_v, 2)) / sum(w) AS b, sum(w * (u - mean_u) * (v - mean_v)) / sum(w) AS c
  FROM p JOIN m USING (p_brand) GROUP BY ALL)
SELECT p_brand, mass, round(mean_u, 6) AS mean_u, round(mean_v, 6) AS mean_v, round((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c), 4) AS major, round((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c), 4) AS minor,
  round(degrees(0.5 * atan2(2 * c, a - b)), 4) + 0.0::DOUBLE AS axis FROM c""",
)
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fits.weighted_moments(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey") % 7 + 1)
    cov = [F.col(c) for c in ("var_u", "var_v", "cov_uv")]
    major, minor = fits.eigenvalues(*cov)
    return m.select("p_brand", "mass", F.round("mean_u", 6).alias("mean_u"), F.round("mean_v", 6).alias("mean_v"), F.round(major, 4).alias("major"), F.round(minor, 4).alias("minor"), (F.round(fits.axis_of(*cov), 4) + 0.0).alias("axis"))


@query(
    "tip_height",
    """
WITH t AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.98) AS p FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(median(l_quantity), 6) AS tip, count(*) AS n_tip FROM lineitem JOIN t USING (l_suppkey) WHERE l_quantity >= p - 3 GROUP BY 1""",
)
def tip_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fits.trimmed_tip(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")
    return rows.withColumn("tip", F.round("tip", 6))


@query(
    "mask_moments",
    f"""
SELECT frame, count(*) AS area, round(avg(u) + 1e-9::DOUBLE, 6) AS mean_u, round(avg(v) + 1e-9::DOUBLE, 6) AS mean_v, round(var_pop(u) + 1e-9::DOUBLE, 6) AS var_u, round(var_pop(v) + 1e-9::DOUBLE, 6) AS var_v, round(covar_pop(u, v) + 1e-9::DOUBLE, 6) + 0.0::DOUBLE AS cov_uv,
  round(count(*) FILTER (u = 0 OR u = 7 OR v = 0 OR v = 7) / 32 + 1e-9::DOUBLE, 6) AS border FROM ({ON_SQL}) GROUP BY frame""",
)
def mask_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Many values are exact binary fractions: a hair above, they round the same way everywhere.
    m = masks.moments(on_pixels(spark, sf_dir), 8, 8)
    return m.select("frame", "area", *[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("mean_u", "mean_v", "var_u", "var_v", "cov_uv", "border")])


@query(
    "mask_iou",
    f"""
WITH a AS (SELECT frame, v, u FROM ({ON_SQL}) WHERE frame % 2 = 0), b AS (SELECT frame - 1 AS frame, v, u FROM ({ON_SQL}) WHERE frame % 2 = 1),
j AS (SELECT coalesce(a.frame, b.frame) AS frame, a.frame IS NOT NULL AS x, b.frame IS NOT NULL AS y FROM a FULL JOIN b ON a.frame = b.frame AND a.v = b.v AND a.u = b.u)
SELECT frame, round(count(*) FILTER (x AND y) / count(*), 6) AS iou, round(2 * count(*) FILTER (x AND y) / (count(*) FILTER (x) + count(*) FILTER (y)), 6) AS dice FROM j GROUP BY frame""",
)
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = on_pixels(spark, sf_dir).drop("value")
    out = masks.overlap(px.filter("frame % 2 = 0"), px.filter("frame % 2 = 1").withColumn("frame", F.col("frame") - 1))
    return out.select("frame", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


@query(
    "mask_vote",
    f"""
WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, v, u, count(*) AS votes FROM ({ON_SQL}) JOIN n USING (label) GROUP BY label, v, u, n HAVING count(*) >= ceil(n / 2)""",
)
def mask_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    px = on_pixels(spark, sf_dir).join(e.select(F.col("vec_id").alias("frame"), "label"), "frame")
    return masks.vote(px, "label", e.groupBy("label").agg(F.count("*").alias("n_frames")))


@query(
    "dilation",
    f"SELECT DISTINCT frame, CAST(v + dv AS INTEGER) AS v, CAST(u + du AS INTEGER) AS u FROM ({PX_SQL}) p, range(-1, 2) a(dv), range(-1, 2) b(du) WHERE value > 0.15 AND v + dv BETWEEN 0 AND 7 AND u + du BETWEEN 0 AND 7",
)
def dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = masks.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, F.col("value") > 0.15)
    return masks.dilate(px, 1, 8, 8)


@query(
    "mask_components",
    f"""
WITH RECURSIVE p AS (SELECT frame, v, u FROM ({PX_SQL}) WHERE value > 0.1),
r AS (SELECT frame, v * 8 + u AS seed, v, u FROM p UNION SELECT r.frame, r.seed, p.v, p.u FROM r JOIN p ON p.frame = r.frame AND abs(p.v - r.v) <= 1 AND abs(p.u - r.u) <= 1),
l AS (SELECT frame, v, u, min(seed) AS c FROM r GROUP BY ALL), s AS (SELECT frame, c, count(*) AS n FROM l GROUP BY ALL)
SELECT frame, count(*) AS n_components, max(n) AS largest FROM s GROUP BY 1""",
)
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.largest_component(masks.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, F.col("value") > 0.1))


def _next_point(k: int, before: list[str]) -> str:
    """SQL of the k-th pick: the pixel farthest from all before it, in reading order."""
    gap = "least(" + ", ".join(f"pow(o.v - {b}.v, 2) + pow(o.u - {b}.u, 2)" for b in before) + ")"
    joins = " ".join(f"JOIN {b} USING (frame)" for b in before)
    return f"t{k} AS (SELECT o.frame, o.v, o.u FROM o {joins} WHERE {gap} > 0 QUALIFY row_number() OVER (PARTITION BY o.frame ORDER BY {gap} DESC, o.v, o.u) = 1)"


POINTS_SQL = f"""
WITH o AS ({ON_SQL}), m AS (SELECT frame, avg(v) AS v, avg(u) AS u FROM o GROUP BY 1),
t0 AS (SELECT o.frame, o.v, o.u FROM o JOIN m USING (frame) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY round(pow(o.v - m.v, 2) + pow(o.u - m.u, 2), 9), o.v, o.u) = 1),
{", ".join(_next_point(k, [f"t{i}" for i in range(k)]) for k in range(1, 5))}
{" UNION ALL ".join(f"SELECT frame, {k} AS rank, v, u FROM t{k}" for k in range(5))}"""


@query("farthest_points", POINTS_SQL)
def farthest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.farthest_points(on_pixels(spark, sf_dir), 5)


@query(
    "voxel_carve",
    f"""
WITH x AS (SELECT frame, v, u, unnest(range(CAST(floor(abs(value) * 16) AS BIGINT), CAST(floor(abs(value) * 32) AS BIGINT) + 1, 2)) AS k FROM ({PX_SQL})),
c AS (SELECT x.* FROM x SEMI JOIN (SELECT * FROM ({ON_SQL})) p ON x.frame = p.frame AND x.v = p.v AND x.u = p.u)
SELECT frame, v, u, unnest(range(min(k), max(k) + 1)) AS k FROM c GROUP BY frame, v, u""",
)
def voxel_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels over the pixels that are on, columns filled."""
    every = masks.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, F.lit(True)).withColumn("value", F.col("value").cast("double"))
    lo, hi = F.floor(F.abs("value") * 16), F.floor(F.abs("value") * 32)
    voxels = every.select("frame", "v", "u", F.explode(F.sequence(lo, hi, F.lit(2).cast("long"))).alias("k"))
    return masks.fill_columns(masks.carve(voxels, on_pixels(spark, sf_dir)))


@query(
    "top_by_share",
    f"""
WITH x AS (SELECT frame, CAST(floor(abs(value) * 32) AS BIGINT) AS k, value > 0 AS lit FROM ({PX_SQL})),
l AS (SELECT frame, k, avg(lit::INTEGER) AS share, count(*) AS n FROM x GROUP BY ALL)
SELECT frame, max(k) FILTER (n >= 5 AND share >= 0.5) AS top, count(*) AS levels FROM l GROUP BY frame""",
)
def top_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest level with enough pixels and half of them lit."""
    every = masks.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, F.lit(True)).withColumn("value", F.col("value").cast("double"))
    levels = every.groupBy("frame", F.floor(F.abs("value") * 32).alias("k")).agg(F.avg((F.col("value") > 0).cast("int")).alias("share"), F.count("*").alias("n"))
    return reports.top_level(levels, ["frame"], "k", "n", "share", 5, 0.5).select("frame", "top", "levels")


@query(
    "limited_tops",
    f"""
WITH x AS (SELECT frame, CAST(floor(abs(value) * 32) AS BIGINT) AS k, value > 0 AS lit FROM ({PX_SQL})), l AS (SELECT frame, k, avg(lit::INTEGER) AS share, count(*) AS n FROM x GROUP BY ALL),
t AS (SELECT frame, max(k) FILTER (n >= 3 AND share >= 0.4) AS top FROM l GROUP BY 1)
SELECT frame, top, CASE WHEN top IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM l WHERE l.frame = t.frame AND l.k = t.top + 1) END AS limited FROM t""",
)
def limited_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tops, and whether nothing was measured above them."""
    every = masks.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, F.lit(True)).withColumn("value", F.col("value").cast("double"))
    levels = every.groupBy("frame", F.floor(F.abs("value") * 32).alias("k")).agg(F.avg((F.col("value") > 0).cast("int")).alias("share"), F.count("*").alias("n"))
    return reports.top_level(levels, ["frame"], "k", "n", "share", 3, 0.4).select("frame", "top", "limited")


@query(
    "background_model",
    f"""
WITH p AS ({PX_SQL}), m AS (SELECT label, v, u, median(value) AS med FROM p GROUP BY ALL)
SELECT label, v, u, round(any_value(med), 6) AS med, round(1.4826 * median(abs(value - med)), 6) AS noise, round(greatest(3 * 1.4826 * median(abs(value - med)), 0.5), 6) AS threshold
FROM p JOIN m USING (label, v, u) GROUP BY label, v, u""",
)
def background_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pixel: temporal median, robust noise, detection threshold."""
    px = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "value"))
    px = px.select("label", F.floor(F.col("i") / 8).cast("int").alias("v"), (F.col("i") % 8).cast("int").alias("u"), F.col("value").cast("double").alias("value"))
    keys = ["label", "v", "u"]
    out = quantiles.robust_noise(px, keys, F.col("value"))
    return out.select(*keys, F.round("med", 6).alias("med"), F.round("noise", 6).alias("noise"), F.round(F.greatest(3 * F.col("noise"), F.lit(0.5)), 6).alias("threshold"))


@query(
    "block_activity",
    f"""
WITH p AS ({PX_SQL}), d AS (SELECT frame, v, u, abs(value - lag(value) OVER (PARTITION BY label, v, u ORDER BY frame)) AS d FROM p),
b AS (SELECT frame, v // 4 AS bv, u // 4 AS bu, avg(d) AS m FROM d WHERE d IS NOT NULL GROUP BY ALL)
SELECT frame, round(max(m), 6) AS peak, round(median(m), 6) AS typical FROM b GROUP BY frame""",
)
def block_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change between a label's frames by blocks of 4 x 4 pixels."""
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.posexplode("embedding").alias("i", "value"))
    block = [F.floor(F.floor(F.col("i") / 8) / 4), F.floor((F.col("i") % 8) / 4)]
    out = reports.block_change(px, ["label"], "frame", ["i"], F.col("value").cast("double"), block)
    return out.select("frame", F.round("peak", 6).alias("peak"), F.round("typical", 6).alias("typical"))
