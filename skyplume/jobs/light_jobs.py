"""Shade, hidden places, corridors and shadows; density modes, mask metrics, registration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.jobs.geometry_jobs import ON_SQL, on_pixels
from skyplume.jobs.image_jobs import GREY_SQL, grey
from skyplume.jobs.raster_jobs import GRID
from skyplume.jobs.registry import query, table
from skyplume.jobs.series_jobs import AZ_SQL, azimuth
from skyplume.jobs.volume_jobs import CAMERA, SOLID_SQL, corner_sql, solid_voxels
from skyplume.operators import frames, light, modes

#: A rough ground of 40 x 25 cells of 5 m.
LAND_SQL = "SELECT CAST(l_orderkey % 40 AS INTEGER) AS ix, CAST(l_partkey % 25 AS INTEGER) AS iy, CAST(sum(l_quantity) % 50 AS DOUBLE) AS z FROM lineitem GROUP BY ALL"
#: West of south-west, some 19 degrees high; a unit vector.
SUN = (-0.8, -0.5, math.sqrt(1 - 0.8**2 - 0.5**2))


def land(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [(F.col("l_orderkey") % 40).cast("int").alias("ix"), (F.col("l_partkey") % 25).cast("int").alias("iy")]
    return table(spark, sf_dir, "lineitem").groupBy(*at).agg((F.sum("l_quantity") % 50).cast("double").alias("z"))


@query(
    "terrain_shade",
    f"""
WITH d AS ({LAND_SQL}), p AS (SELECT ix * 25 + iy AS id, ix * 5 + 1.25::DOUBLE AS x, iy * 5 + 2.0::DOUBLE AS y, z + 0.5 AS z FROM d),
s AS (SELECT id, (x + k * 4 * ({SUN[0]!r})::DOUBLE) / 5 AS fx, (y + k * 4 * ({SUN[1]!r})::DOUBLE) / 5 AS fy, z + k * 4 * ({SUN[2]!r})::DOUBLE AS z FROM p, range(1, 41) t(k)),
c AS (SELECT *, least(floor(fx), 38) AS i, least(floor(fy), 23) AS j FROM s WHERE fx BETWEEN 0 AND 39 AND fy BETWEEN 0 AND 24)
SELECT DISTINCT c.id FROM c JOIN d a ON a.ix = i AND a.iy = j JOIN d b ON b.ix = i + 1 AND b.iy = j JOIN d e ON e.ix = i AND e.iy = j + 1 JOIN d f ON f.ix = i + 1 AND f.iy = j + 1
WHERE (a.z * (1 - (fx - i)) + b.z * (fx - i)) * (1 - (fy - j)) + (e.z * (1 - (fx - i)) + f.z * (fx - i)) * (fy - j) > c.z""",
)
def terrain_shade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that the ground keeps from the sun, against all steps of all rays."""
    cells = land(spark, sf_dir)
    at = cells.select((F.col("ix") * 25 + F.col("iy")).alias("id"), (GRID.x0 + F.col("ix") * 5 + 1.25).alias("x"), (GRID.y0 + F.col("iy") * 5 + 2.0).alias("y"), (F.col("z") + 0.5).alias("z"))
    return light.shaded(at, "id", ["x", "y", "z"], SUN, cells, GRID, 160.0, 4.0, (16, 4))


#: Voxels' centres in metres, as the camera of the silhouettes has them.
CENTRE_SQL = f"SELECT frame, v, u, k, (u - 4.5) * 2 AS x, (v - 4.5) * 2 AS y, k * 2.0::DOUBLE AS z FROM ({SOLID_SQL})"


def depth_sql() -> str:
    return " + ".join(f"({a[2]!r}::DOUBLE) * ({p} - ({c!r}::DOUBLE))" for a, p, c in zip(CAMERA.axes, "xyz", CAMERA.centre, strict=True))


@query(
    "hidden_voxels",
    f"""
WITH s AS ({CENTRE_SQL}), p AS (SELECT frame, v, u, k, {corner_sql()}, {depth_sql()} AS depth FROM s),
q AS (SELECT *, CAST(round_even(pv, 0) AS INTEGER) AS cv, CAST(round_even(pu, 0) AS INTEGER) AS cu FROM p WHERE round_even(pu, 0) BETWEEN 0 AND 95 AND round_even(pv, 0) BETWEEN 0 AND 63),
g AS (SELECT cv, cu, avg(depth) AS ground FROM q WHERE (cv + cu) % 3 > 0 GROUP BY ALL)
SELECT q.frame, count(*) AS ahead, count(*) FILTER (ground IS NULL OR depth < ground + 1.5) AS seen FROM q LEFT JOIN g ON g.cv = q.cv AND g.cu = q.cu GROUP BY 1""",
)
def hidden_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels before and behind the mean depth that all frames have at their pixel; a third of the pixels has none."""
    at = solid_voxels(spark, sf_dir).select("frame", "v", "u", "k", ((F.col("u") - 4.5) * 2).alias("x"), ((F.col("v") - 4.5) * 2).alias("y"), (F.col("k") * 2.0).alias("z"))
    u, v = CAMERA.pixel(F.col("x"), F.col("y"), F.col("z"))
    depths = at.filter(CAMERA.in_frame(u, v)).select(F.rint(v).cast("int").alias("v"), F.rint(u).cast("int").alias("u"), CAMERA.depth(F.col("x"), F.col("y"), F.col("z")).alias("depth")).filter("(v + u) % 3 > 0").groupBy("v", "u").agg(F.avg("depth").alias("depth"))
    rows = light.unhidden(at, ["x", "y", "z"], CAMERA, depths, 1.5).filter(CAMERA.in_frame(u, v))
    return rows.groupBy("frame").agg(F.count("*").alias("ahead"), F.count("cam_v").alias("seen"))


def ground_pixels(spark: SparkSession) -> DataFrame:
    """A plain of 40 x 40 places a metre apart, each with a pixel of its own."""
    return spark.range(1600).select(F.floor(F.col("id") / 40).cast("int").alias("v"), (F.col("id") % 40).cast("int").alias("u")).select("v", "u", (F.col("u") - 20.0).alias("x"), (F.col("v") - 20.0).alias("y"), F.lit(0.0).alias("z"))


@query(
    "cast_shadows",
    f"""
WITH g AS (SELECT v, u, u - 20.0::DOUBLE AS x, v - 20.0::DOUBLE AS y FROM range(0, 40, 2) a(v), range(0, 40, 2) b(u)),
r AS (SELECT DISTINCT g.v, g.u, CAST(round_even((x + k * 1.2 * 0.6::DOUBLE + 9) / 2, 0) AS INTEGER) AS su, CAST(round_even((y + 9) / 2, 0) AS INTEGER) AS sv, CAST(round_even(k * 1.2 * 0.8::DOUBLE / 2, 0) AS INTEGER) AS sk FROM g, range(1, 60) t(k)),
d AS (SELECT DISTINCT frame, r.v, r.u FROM r JOIN ({SOLID_SQL}) s ON s.v = sv AND s.u = su AND s.k = sk)
SELECT frame, CAST(v + a AS INTEGER) AS v, CAST(u + b AS INTEGER) AS u FROM d, range(2) x(a), range(2) y(b)""",
)
def cast_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadows of solids on a plain, every second pixel for its square."""
    return light.cast_shadow(ground_pixels(spark), solid_voxels(spark, sf_dir), ["frame"], (-9.0, -9.0, 0.0), (10, 10, 14), 2.0, (0.6, 0.0, 0.8), 2, 1.2)


#: A camera of 8 x 8 pixels over ground that each of them sees a piece of.
SMALL = Camera.at(5.0, (0.0, -30.0, 12.0), 0.0, -10.0, 8, 8)
SMALL_PART = lambda k: " + ".join(f"({a[k]!r}::DOUBLE) * ({p} - ({c!r}::DOUBLE))" for a, p, c in zip(SMALL.axes, "xyz", SMALL.centre, strict=True))


@query(
    "column_shadows",
    f"""
WITH g AS (SELECT v, u, u * 5 - 17.5::DOUBLE AS x0, v * 5 - 10.0::DOUBLE AS y0 FROM range(8) a(v), range(8) b(u)),
s AS (SELECT v, u, x0 + k * 3 * 0.6::DOUBLE AS x, y0 AS y, k * 3 * 0.8::DOUBLE AS z FROM g, range(1, 10) t(k)),
p AS (SELECT v, u, 5 * ({SMALL_PART(0)}) / ({SMALL_PART(2)}) + 4 AS pu, 5 * ({SMALL_PART(1)}) / ({SMALL_PART(2)}) + 4 AS pv FROM s WHERE {SMALL_PART(2)} > 1e-9),
w AS (SELECT DISTINCT v, u, CAST(round_even(pv, 0) AS INTEGER) AS gv, CAST(round_even(pu, 0) AS INTEGER) AS gu FROM p WHERE round_even(pu, 0) BETWEEN 0 AND 7 AND round_even(pv, 0) BETWEEN 0 AND 7),
o AS (SELECT frame, v, u FROM ({ON_SQL})), gas AS (SELECT * FROM o WHERE (v + u) % 2 = 0), allowed AS (SELECT DISTINCT gas.frame, w.v, w.u FROM w JOIN gas ON gas.v = gv AND gas.u = gu)
SELECT o.frame, o.v, o.u FROM o SEMI JOIN allowed a ON a.frame = o.frame AND a.v = o.v AND a.u = o.u WHERE (o.v + o.u) % 2 = 1 AND NOT (o.v = 3 AND o.u BETWEEN 2 AND 4 OR o.u = 3 AND o.v IN (2, 4))""",
)
def column_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark pixels on the way from the gas (every other one) to the sun, neither gas nor near a fixed shadow."""
    dark = on_pixels(spark, sf_dir).select("frame", "v", "u")
    ground = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("v"), (F.col("id") % 8).cast("int").alias("u"))
    ground = ground.select("v", "u", (F.col("u") * 5 - 17.5).alias("x"), (F.col("v") * 5 - 10.0).alias("y"), F.lit(0.0).alias("z"))
    ways = light.corridor(ground, SMALL, (0.6, 0.0, 0.8), 21.6, 3.0)
    return light.column_shadow(dark, dark.filter("(v + u) % 2 = 0"), spark.createDataFrame([(3, 3)], "v int, u int"), ways, 8, 8, 1, 0)


@query(
    "direction_bimodality",
    f"""
WITH a AS (SELECT user_id, CAST(round_even(({AZ_SQL} + 180) * 2, 0) AS BIGINT) % 720 AS c FROM events), h AS (SELECT user_id, c, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT user_id, sum(n) AS n FROM h GROUP BY 1),
w AS (SELECT d, exp(40 * (cos(radians(d / 2.0::DOUBLE)) - 1)) AS w FROM range(-360, 360) r(d)),
k AS (SELECT t.user_id, t.n, cell, f FROM t, range(720) r(cell), (SELECT user_id AS id, (c + d + 720) % 720 AS at, round(sum(h.n * w), 9) AS f FROM h, w WHERE w >= 1e-12 GROUP BY ALL) x WHERE x.id = t.user_id AND x.at = cell
  UNION ALL SELECT t.user_id, t.n, cell, 0 FROM t, range(720) r(cell) WHERE NOT EXISTS (SELECT 1 FROM h, w WHERE w >= 1e-12 AND h.user_id = t.user_id AND (c + d + 720) % 720 = cell)),
p AS (SELECT a.user_id, a.cell, a.f FROM k a JOIN k b ON b.user_id = a.user_id AND b.cell = (a.cell + 719) % 720 JOIN k c ON c.user_id = a.user_id AND c.cell = (a.cell + 1) % 720 WHERE a.f > b.f AND a.f >= c.f AND a.n >= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f DESC, cell DESC) AS r FROM p),
m AS (SELECT x.user_id, x.cell AS i, y.cell AS j, x.f AS hi, y.f AS lo, (y.cell - x.cell + 720) % 720 AS w FROM r x JOIN r y ON y.user_id = x.user_id AND x.r = 1 AND y.r = 2),
l AS (SELECT m.*, min(k.f) AS least FROM m JOIN k ON k.user_id = m.user_id AND CASE WHEN w <= 720 - w THEN (cell - i + 720) % 720 <= w ELSE (cell - j + 720) % 720 <= 720 - w END GROUP BY ALL)
SELECT t.user_id, t.n, coalesce(1 - least / lo > 0.3 AND lo / hi > 0.25 AND least(w, 720 - w) / 2 > 15, false) AS bimodal, i / 2 - 180 AS first, j / 2 - 180 AS second, least(w, 720 - w) / 2 AS separation, round(lo / hi, 6) AS height, round(1 - least / lo, 6) AS dip FROM t LEFT JOIN l USING (user_id)""",
)
def direction_bimodality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose directions have two modes; kappa 40, as a user has some dozen events."""
    out = modes.density_modes(table(spark, sf_dir, "events"), ["user_id"], azimuth(), kappa=40.0, least=40)
    return out.select("user_id", "n", "bimodal", "first", "second", "separation", F.round("height", 6).alias("height"), F.round("dip", 6).alias("dip"))


@query(
    "mask_texture",
    f"""
WITH g AS ({GREY_SQL}), s AS (SELECT p.frame, CAST(a.v AS INTEGER) AS v, CAST(b.u AS INTEGER) AS u, sqrt(pow(sum(value * du * (2 - abs(dv))), 2) + pow(sum(value * dv * (2 - abs(du))), 2)) AS m, any_value(value) FILTER (dv = 0 AND du = 0) AS x
  FROM range(8) a(v), range(8) b(u), range(-1, 2) c(dv), range(-1, 2) d(du), g p WHERE p.v = greatest(least(a.v + dv, 7), 0) AND p.u = greatest(least(b.u + du, 7), 0) GROUP BY ALL),
o AS (SELECT frame, v, u FROM ({ON_SQL})), w AS (SELECT DISTINCT frame, v + a AS v, u + b AS u FROM o, range(-1, 2) x(a), range(-1, 2) y(b)),
j AS (SELECT s.*, o.frame IS NOT NULL AS own, w.frame IS NOT NULL AND o.frame IS NULL AS ring, least(s.u, 7 - s.u, s.v, 7 - s.v) AS far FROM s LEFT JOIN o ON o.frame = s.frame AND o.v = s.v AND o.u = s.u LEFT JOIN w ON w.frame = s.frame AND w.v = s.v AND w.u = s.u),
r AS (SELECT frame, median(m) AS steep FROM j WHERE ring GROUP BY 1)
SELECT j.frame, count(*) FILTER (own) AS area, round(avg((m > steep)::INTEGER) FILTER (own), 6) AS texture, round(avg(m) FILTER (own), 5) AS texture_in, round(avg(m) FILTER (ring), 5) AS texture_ring,
  round(abs(avg(x) FILTER (own) - avg(x) FILTER (ring)) / sqrt(0.5 * (var_pop(x) FILTER (own) + var_pop(x) FILTER (ring)) + 1e-9), 5) AS contrast, round(stddev_pop(x) FILTER (own), 5) AS std_in, round(quantile_cont(far, 0.05) FILTER (own), 6) AS edge_distance, round(avg((far < 0.32)::INTEGER) FILTER (own), 6) AS edge_share, round(avg((far < 1)::INTEGER) FILTER (own), 6) AS cut
FROM j JOIN r USING (frame) GROUP BY 1""",
)
def mask_texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture and contrast of each frame's mask against a ring of one pixel."""
    out = frames.mask_metrics(grey(spark, sf_dir), on_pixels(spark, sf_dir), 8, 8, 1)
    return out.select("frame", "area", *[F.round(c, 6 if c in ("texture", "edge_distance", "edge_share", "cut") else 5).alias(c) for c in out.columns[2:]])


SIDE, TILES = 48, 36


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, v, u, value): each 36 arrays of 8 x 8 as one picture of 48 x 48; a picture that lacks a tile is left out."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / TILES).alias("frame"), (F.col("vec_id") % TILES).alias("tile"), "embedding")
    whole = rows.groupBy("frame").agg(F.countDistinct("tile").alias("_n")).filter(F.col("_n") == TILES).select("frame")
    rows = rows.join(whole, "frame").select("frame", "tile", F.posexplode("embedding").alias("i", "x"))
    v, u = F.floor(F.col("tile") / 6) * 8 + F.floor(F.col("i") / 8), F.col("tile") % 6 * 8 + F.col("i") % 8
    return rows.select("frame", v.cast("int").alias("v"), u.cast("int").alias("u"), (F.col("x").cast("double") * 200 + 128).alias("value"))


@query(
    "frame_moves",
    "SELECT vec_id // 36 AS frame, CAST(any_value(vec_id // 36) % 5 - 2 AS DOUBLE) AS across, CAST(any_value(vec_id // 36) % 3 - 1 AS DOUBLE) AS down, 0.0::DOUBLE AS degrees, true AS converged FROM embeddings GROUP BY 1 HAVING count(DISTINCT vec_id % 36) = 36",
)
def frame_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each picture moved by what its number says, and the move found again."""
    back = mosaics(spark, sf_dir)
    # Where the picture is (v, u) the moved one has (v - down, u - across).
    moved = back.select("frame", (F.col("v") - (F.col("frame") % 3 - 1)).cast("int").alias("v"), (F.col("u") - (F.col("frame") % 5 - 2)).cast("int").alias("u"), "value")
    out = frames.registered(moved, back, SIDE, SIDE, sigma=2.0)
    near = lambda c: (F.round(c, 1) + 0.0).alias(c)
    return out.select("frame", near("across"), near("down"), near("degrees"), "converged")
