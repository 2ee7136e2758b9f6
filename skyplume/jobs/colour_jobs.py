"""Colour spaces, shadow in colour frames, and the camera's direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions import colour as K
from skyplume.functions.camera import Camera
from skyplume.jobs.geometry_jobs import PX_SQL
from skyplume.jobs.mask_jobs import all_pixels
from skyplume.jobs.registry import query, table
from skyplume.operators import colours, orientation
from skyplume.operators.rasters import Grid

RGB_SQL = f"SELECT frame, v, u, CAST(128 + floor(value * 250) AS INTEGER) AS r, CAST(100 + floor(abs(value) * 300) AS INTEGER) AS g, CAST(90 + (frame * 7 + v * 31 + u * 17) % 120 AS INTEGER) AS b FROM ({PX_SQL})"
BACK_SQL = f"SELECT v, u, CAST(median(r) AS DOUBLE) AS r, CAST(median(g) AS DOUBLE) AS g, CAST(median(b) AS DOUBLE) AS b FROM ({RGB_SQL}) GROUP BY ALL"
LINEAR = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
Y_SQL = " + ".join(f"{w}::DOUBLE * ({LINEAR.format(c=f'least(greatest({c}, 0), 255)')})" for w, c in zip(K.LUMINANCE, "rgb", strict=True))
LIGHT_SQL = f"2.55::DOUBLE * CASE WHEN {Y_SQL} > 0.008856 THEN 116 * pow({Y_SQL}, 1 / 3.0::DOUBLE) - 16 ELSE 903.3 * ({Y_SQL}) END"
LUMA_SQL = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"
SAT_SQL = "coalesce(255.0::DOUBLE * (greatest(r, g, b) - least(r, g, b)) / nullif(greatest(r, g, b), 0), 0)"


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pixels of small frames."""
    x = F.col("value")
    return all_pixels(spark, sf_dir).select("frame", "v", "u", (128 + F.floor(x * 250)).cast("int").alias("r"), (100 + F.floor(F.abs(x) * 300)).cast("int").alias("g"), (90 + (F.col("frame") * 7 + F.col("v") * 31 + F.col("u") * 17) % 120).cast("int").alias("b"))


@query(
    "colour_spaces",
    f"""
WITH p AS ({RGB_SQL}), h AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM p),
k AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN 30.0::DOUBLE * (g - b) / (hi - lo) WHEN hi = g THEN 60 + 30.0::DOUBLE * (b - r) / (hi - lo) ELSE 120 + 30.0::DOUBLE * (r - g) / (hi - lo) END AS hue FROM h)
SELECT frame, v, u, round({LIGHT_SQL}, 5) AS light, round(CASE WHEN hue < 0 THEN hue + 180 ELSE hue END, 5) AS hue, round({SAT_SQL}, 5) AS saturation, round((r - {LUMA_SQL}) * 0.713::DOUBLE + 128, 7) AS red, round(least(greatest(r * 1.12::DOUBLE, 0), 255), 7) AS warm FROM k""",
)
def colour_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in the spaces that shadow is judged in, and with another white balance."""
    c = tuple(F.col(x) for x in "rgb")
    hue, saturation, _ = K.hsv(*c)
    warm = K.balanced(c, (1.12, 1.0, 0.9))[0]
    return rgb(spark, sf_dir).select("frame", "v", "u", *[F.round(x, digits).alias(n) for x, n, digits in ((K.lightness(*c), "light", 5), (hue, "hue", 5), (saturation, "saturation", 5), (K.red_difference(*c), "red", 7), (warm, "warm", 7))])


@query(
    "shadow_maps",
    f"""
WITH p AS ({RGB_SQL}), b AS ({BACK_SQL}), y AS (SELECT frame, v, u, {LUMA_SQL} AS y FROM p UNION ALL SELECT -1, v, u, {LUMA_SQL} FROM b),
e AS (SELECT y.frame, CAST(a.v AS INTEGER) AS v, CAST(c.u AS INTEGER) AS u, pow(sum(y.y * du * (2 - abs(dv))), 2) + pow(sum(y.y * dv * (2 - abs(du))), 2) AS e FROM range(8) a(v), range(8) c(u), range(-1, 2) d(dv), range(-1, 2) f(du), y WHERE y.v = greatest(least(a.v + dv, 7), 0) AND y.u = greatest(least(c.u + du, 7), 0) GROUP BY ALL),
s AS (SELECT p.frame, p.v, p.u, l.light, bs.s - ps.s AS lost, pr.red, sqrt(greatest(eb.e - ef.e, 0)) AS edges FROM p
  JOIN (SELECT frame, v, u, {LIGHT_SQL} AS light FROM p) l USING (frame, v, u) JOIN (SELECT frame, v, u, {SAT_SQL} AS s FROM p) ps USING (frame, v, u) JOIN (SELECT frame, v, u, (r - {LUMA_SQL}) * 0.713::DOUBLE + 128 AS red FROM p) pr USING (frame, v, u)
  JOIN e ef USING (frame, v, u) JOIN (SELECT v, u, {SAT_SQL} AS s FROM b) bs ON bs.v = p.v AND bs.u = p.u JOIN e eb ON eb.frame = -1 AND eb.v = p.v AND eb.u = p.u)
SELECT frame, v, u, round(0.35::DOUBLE / (1 + exp(0.08::DOUBLE * (light - 80))) + 0.25::DOUBLE / (1 + exp(0.10::DOUBLE * (lost - 30))) + 0.20::DOUBLE / (1 + exp(0.06::DOUBLE * (red - 120))) + 0.20::DOUBLE / (1 + exp(0.12::DOUBLE * (edges - 20))), 5) AS score FROM s""",
)
def shadow_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for shadow at each pixel against the median of all frames."""
    px = rgb(spark, sf_dir)
    back = px.groupBy("v", "u").agg(*[F.median(c).alias(c) for c in "rgb"])
    return colours.shadow_scores(px, back, 8, 8).select("frame", "v", "u", F.round("score", 5).alias("score"))


#: A camera 90 m up that looks down at 30 degrees; a map of cells of 4 m.
CAMERA = Camera.at(90.0, (400.0, 400.0, 90.0), 0.0, -30.0, 128, 96)
CHART, GROUND = Grid(2.0, 2.0, 4.0, 200, 200), Grid(0.0, 0.0, 40.0, 21, 21)
TRUE_YAW = 52.0


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of patches of 16 m, grey by the line items that fall on them."""
    patch = lambda c, k: (F.col(c) * k % 50).cast("int")
    grey = table(spark, sf_dir, "lineitem").groupBy(patch("l_orderkey", 7).alias("_a"), patch("l_partkey", 11).alias("_b")).agg((F.sum("l_quantity") * 37 % 251).cast("double").alias("value"))
    within = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(4) for j in range(4)]))
    return grey.withColumn("_w", within).select((F.col("_a") * 4 + F.col("_w.i")).alias("ix"), (F.col("_b") * 4 + F.col("_w.j")).alias("iy"), "value")


def hills(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [(F.col("l_orderkey") % 21).cast("int").alias("ix"), (F.col("l_suppkey") * 5 % 21).cast("int").alias("iy")]
    cells = table(spark, sf_dir, "lineitem").groupBy(*at).agg((F.count("*") % 13).cast("double").alias("z"))
    flat = spark.range(441).select((F.col("id") % 21).cast("int").alias("ix"), F.floor(F.col("id") / 21).cast("int").alias("iy"), F.lit(0.0).alias("z"))
    return cells.union(flat).groupBy("ix", "iy").agg(F.max("z").alias("z"))


@query("camera_direction", "SELECT 52.0::DOUBLE AS yaw, true AS near_truth, 11 AS angles FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 0")
def camera_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of the map at 52 degrees, looked for between 42 and 62: the angle is found again."""
    picture, land = chart(spark, sf_dir), hills(spark, sf_dir)
    seen = lambda yaws: orientation.seen_map(CAMERA, yaws, -30.0, 2, picture, CHART, land, GROUND, 4.0, 600.0)
    scores = orientation.yaw_scores(seen([TRUE_YAW - 10 + 2 * k for k in range(11)]), seen([TRUE_YAW]).drop("yaw"), 48, 64, 6, 1.0, 6.0)
    best = orientation.best_yaw(scores)
    return best.select("yaw", (F.abs(F.col("refined") - TRUE_YAW) < 0.7).alias("near_truth"), F.lit(11).alias("angles"))
