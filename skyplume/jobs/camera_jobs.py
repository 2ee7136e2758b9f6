"""Pixels and the world: rays, planes, projection, the sun, light."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions import camera as K
from skyplume.functions import physics as P
from skyplume.jobs.registry import query, table
from skyplume.operators import fits

CAMERA = K.Camera.at(1400.0, (500.0, 400.0, 120.0), 30.0, -35.0, 1920, 1080)
#: The same camera by its angles: yaw 30, pitch -35 degrees.
AXES_SQL = """
c AS (SELECT sin(radians(30.0::DOUBLE)) AS sy, cos(radians(30.0::DOUBLE)) AS cy, sin(radians(-35.0::DOUBLE)) AS sp, cos(radians(-35.0::DOUBLE)) AS cp),
r AS (SELECT cy AS r0, -sy AS r1, 0.0::DOUBLE AS r2, sy * sp AS d0, cy * sp AS d1, -cp AS d2, sy * cp AS f0, cy * cp AS f1, sp AS f2 FROM c)"""
PIXELS_SQL = "SELECT p_partkey, p_size * 38.0::DOUBLE AS u, (p_retailprice * 7) % 1080 AS v, (p_partkey % 30)::DOUBLE AS z FROM part"
POINTS_SQL = "SELECT p_partkey, 450 + p_size * 6.0::DOUBLE AS x, 380 + (p_retailprice * 3) % 400 AS y, (p_partkey % 60)::DOUBLE AS z FROM part"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 38.0).alias("u"), ((F.col("p_retailprice") * 7) % 1080).alias("v"), (F.col("p_partkey") % 30).cast("double").alias("z"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (450 + F.col("p_size") * 6.0).alias("x"), (380 + (F.col("p_retailprice") * 3) % 400).alias("y"), (F.col("p_partkey") % 60).cast("double").alias("z"))


RAY_SQL = f"""
WITH {AXES_SQL}, p AS ({PIXELS_SQL}), q AS (SELECT *, (u - 960) / 1400 AS a, (v - 540) / 1400 AS b FROM p, r),
d AS (SELECT p_partkey, z, (r0 * a + d0 * b + f0) / sqrt(a * a + b * b + 1) AS dx, (r1 * a + d1 * b + f1) / sqrt(a * a + b * b + 1) AS dy, (r2 * a + d2 * b + f2) / sqrt(a * a + b * b + 1) AS dz FROM q)"""


@query(
    "pixels_on_plane",
    RAY_SQL + """
SELECT p_partkey, round(dx, 8) AS dx, round(dy, 8) AS dy, round(dz, 8) AS dz, CASE WHEN (z - 120) / dz > 0 THEN round(500 + (z - 120) / dz * dx, 4) END AS x, CASE WHEN (z - 120) / dz > 0 THEN round(400 + (z - 120) / dz * dy, 4) END AS y FROM d""",
)
def pixels_on_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays of pixels and where they meet a plane."""
    u, v, z = (F.col(c) for c in ("u", "v", "z"))
    d, (x, y) = CAMERA.ray(u, v), CAMERA.on_plane(u, v, z)
    return pixels(spark, sf_dir).select("p_partkey", *[F.round(c, 8).alias(n) for c, n in zip(d, ("dx", "dy", "dz"), strict=True)], F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


PROJECT_SQL = f"""
WITH {AXES_SQL}, p AS ({POINTS_SQL}), q AS (SELECT p_partkey, x, y, z, r0 * (x - 500) + r1 * (y - 400) + r2 * (z - 120) AS a, d0 * (x - 500) + d1 * (y - 400) + d2 * (z - 120) AS b, f0 * (x - 500) + f1 * (y - 400) + f2 * (z - 120) AS c FROM p, r),
t AS (SELECT p_partkey, x, y, z, c, CASE WHEN c > 1e-9 THEN 1400 * a / c + 960 END AS u, CASE WHEN c > 1e-9 THEN 1400 * b / c + 540 END AS v FROM q)"""


@query(
    "points_in_frame",
    PROJECT_SQL + " SELECT p_partkey, round(u, 4) AS u, round(v, 4) AS v, round(c, 6) AS depth, coalesce(round_even(u, 0) BETWEEN 0 AND 1919 AND round_even(v, 0) BETWEEN 0 AND 1079, false) AS in_frame FROM t",
)
def points_in_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection, depth, and whether a point is in front of the camera and in the frame."""
    xyz = [F.col(c) for c in ("x", "y", "z")]
    u, v = CAMERA.pixel(*xyz)
    return points(spark, sf_dir).select("p_partkey", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), F.round(CAMERA.depth(*xyz), 6).alias("depth"), CAMERA.in_frame(u, v).alias("in_frame"))


@query(
    "unhidden_points",
    PROJECT_SQL + """, w AS (SELECT *, CAST(round_even(u, 0) AS INTEGER) // 64 AS tu, CAST(round_even(v, 0) AS INTEGER) // 64 AS tv FROM t WHERE round_even(u, 0) BETWEEN 0 AND 1919 AND round_even(v, 0) BETWEEN 0 AND 1079),
g AS (SELECT tu, tv, median(c) AS ground FROM w GROUP BY ALL)
SELECT p_partkey, round(c, 6) AS depth FROM w JOIN g USING (tu, tv) WHERE c < ground + 1.5 * 5""",
)
def unhidden_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the frame that are not behind the ground: nearer than its depth at their pixel plus one and a half cells."""
    xyz = [F.col(c) for c in ("x", "y", "z")]
    u, v = CAMERA.pixel(*xyz)
    tile = lambda c: F.floor(F.rint(c) / 64).cast("int")
    seen = points(spark, sf_dir).filter(CAMERA.in_frame(u, v)).select("p_partkey", tile(u).alias("tu"), tile(v).alias("tv"), CAMERA.depth(*xyz).alias("depth"))
    ground = seen.groupBy("tu", "tv").agg(F.median("depth").alias("ground"))
    return seen.join(ground, ["tu", "tv"]).filter(F.col("depth") < F.col("ground") + 1.5 * 5).select("p_partkey", F.round("depth", 6).alias("depth"))


@query(
    "metres_per_pixel",
    f"""
WITH {AXES_SQL}, p AS ({PIXELS_SQL}), s AS (SELECT p_partkey, z, k, u + CASE WHEN k = 1 THEN 2 ELSE 0 END AS u, v + CASE WHEN k = 2 THEN 2 ELSE 0 END AS v FROM p, range(3) t(k)),
q AS (SELECT s.*, (u - 960) / 1400 AS a, (v - 540) / 1400 AS b, r.* FROM s, r),
d AS (SELECT p_partkey, k, r0 * a + d0 * b + f0 AS dx, r1 * a + d1 * b + f1 AS dy, (z - 120) / (r2 * a + d2 * b + f2) AS t FROM q),
x AS (SELECT p_partkey, max(t * dx) FILTER (k = 0 AND t > 0) AS x0, max(t * dy) FILTER (k = 0 AND t > 0) AS y0, max(t * dx) FILTER (k = 1 AND t > 0) AS x1, max(t * dy) FILTER (k = 1 AND t > 0) AS y1, max(t * dx) FILTER (k = 2 AND t > 0) AS x2, max(t * dy) FILTER (k = 2 AND t > 0) AS y2 FROM d GROUP BY 1)
SELECT p_partkey, round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / 2, 5) AS across, round(sqrt(pow(x2 - x0, 2) + pow(y2 - y0, 2)) / 2, 5) AS down FROM x""",
)
def metres_per_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = CAMERA.scale(F.col("u"), F.col("v"), F.col("z"))
    return pixels(spark, sf_dir).select("p_partkey", F.round(a, 5).alias("across"), F.round(b, 5).alias("down"))


@query(
    "rays_in_box",
    RAY_SQL + """,
t AS (SELECT p_partkey, greatest(least((450 - 500) / dx, (700 - 500) / dx), least((400 - 400) / dy, (800 - 400) / dy), least((0 - 120) / dz, (60 - 120) / dz), 0) AS a,
  least(greatest((450 - 500) / dx, (700 - 500) / dx), greatest((400 - 400) / dy, (800 - 400) / dy), greatest((0 - 120) / dz, (60 - 120) / dz)) AS b FROM d)
SELECT p_partkey, CASE WHEN b > a THEN round(a, 4) END AS enters, CASE WHEN b > a THEN round(b, 4) END AS leaves FROM t""",
)
def rays_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where rays enter and leave a volume."""
    d = CAMERA.ray(F.col("u"), F.col("v"))
    a, b = K.box_span([F.lit(c) for c in CAMERA.centre], d, [450.0, 400.0, 0.0], [700.0, 800.0, 60.0])
    return pixels(spark, sf_dir).select("p_partkey", F.round(a, 4).alias("enters"), F.round(b, 4).alias("leaves"))


@query(
    "world_sigmas",
    f"""
WITH {AXES_SQL}, e AS (SELECT l_suppkey AS frame, l_quantity * 30.0::DOUBLE AS u, 600 + l_linenumber * 50.0::DOUBLE AS v, l_discount AS w FROM lineitem),
s AS (SELECT row_number() OVER () AS id, * FROM e), h AS (SELECT id, frame, w, k, u + CASE WHEN k = 1 THEN 0.5 ELSE 0 END AS u, v + CASE WHEN k = 2 THEN 0.5 ELSE 0 END AS v FROM s, range(3) t(k)),
q AS (SELECT h.*, (u - 960) / 1400 AS a, (v - 540) / 1400 AS b, r.* FROM h, r),
d AS (SELECT id, frame, w, k, r0 * a + d0 * b + f0 AS dx, r1 * a + d1 * b + f1 AS dy, (10 - 120) / (r2 * a + d2 * b + f2) AS t FROM q),
x AS (SELECT id, any_value(frame) AS frame, any_value(w) AS w, max(500 + t * dx) FILTER (k = 0 AND t > 0) AS x0, max(400 + t * dy) FILTER (k = 0 AND t > 0) AS y0, max(500 + t * dx) FILTER (k = 1 AND t > 0) AS x1, max(400 + t * dy) FILTER (k = 1 AND t > 0) AS y1,
  max(500 + t * dx) FILTER (k = 2 AND t > 0) AS x2, max(400 + t * dy) FILTER (k = 2 AND t > 0) AS y2 FROM d GROUP BY 1),
g AS (SELECT frame, x0 AS x, y0 AS y, w * 4 * abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) AS w FROM x),
m AS (SELECT frame, count(*) AS n_used, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM g WHERE w > 0 GROUP BY 1 HAVING count(*) >= 50),
o AS (SELECT frame, n_used, mx, my, sum(w * pow(x - mx, 2)) / sum(w) AS sxx, sum(w * pow(y - my, 2)) / sum(w) AS syy, sum(w * (x - mx) * (y - my)) / sum(w) AS sxy FROM g JOIN m USING (frame) WHERE w > 0 GROUP BY ALL)
SELECT frame, n_used, round(mx, 4) AS east, round(my, 4) AS north, round(sqrt((sxx + syy) / 2 + sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy)), 4) AS major, round(sqrt(greatest((sxx + syy) / 2 - sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy), 0)), 4) AS minor,
  round(((90 - degrees(0.5 * atan2(2 * sxy, sxx - syy))) % 180 + 180) % 180, 4) AS azimuth FROM o""",
)
def world_sigmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of clouds in metres, pixels weighted by opacity and their ground area."""
    px = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_quantity") * 30.0).alias("u"), (600 + F.col("l_linenumber") * 50.0).alias("v"), "l_discount")
    out = fits.world_sigmas(px, ["frame"], CAMERA, F.lit(10.0), F.col("l_discount"))
    return out.select("frame", "n_used", *[F.round(c, 4).alias(c) for c in ("east", "north", "major", "minor", "azimuth")])


@query(
    "phase_and_tone",
    """
SELECT event_id, round((1 - 0.49::DOUBLE) / pow(1 + 0.49::DOUBLE - 1.4::DOUBLE * cos(radians(value)), 1.5), 6) AS phase, round(255 * pow(least(greatest(1.2::DOUBLE * value + 5, 0), 255) / 255, 1 / 2.2::DOUBLE), 6) AS toned,
  round(0.299::DOUBLE * value + 0.587::DOUBLE * (value / 2) + 0.114::DOUBLE * (value / 3), 6) AS luma FROM events""",
)
def phase_and_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scattering by angle, and a level through gain, offset, gamma and luma."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(P.scattering(F.cos(F.radians(v)), 0.7), 6).alias("phase"), F.round(P.toned(v, 1.2, 5.0, 2.2), 6).alias("toned"), F.round(P.luma(v, v / 2, v / 3), 6).alias("luma"))
