"""Terrain: windows, lookups, rays and optical depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.jobs.geometry_jobs import PX_SQL
from skyplume.jobs.mask_jobs import all_pixels
from skyplume.jobs.registry import query, table
from skyplume.operators import rasters

GRID = rasters.Grid(1000.0, 2000.0, 5.0, 40, 25)
#: Cells by their two keys; cheap ones have no data.
DEM_SQL = "SELECT CAST(p_partkey % 40 AS INTEGER) AS ix, CAST(p_partkey // 40 % 25 AS INTEGER) AS iy, round(avg(CASE WHEN p_size < 4 THEN -9999 ELSE p_size END), 6) AS z FROM part GROUP BY ALL"
POINT_SQL = "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, l_quantity, 990 + l_quantity * 4.3::DOUBLE AS x, 1995 + l_discount * 1300 AS y FROM lineitem"


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cell = [(F.col("p_partkey") % 40).cast("int").alias("ix"), (F.floor(F.col("p_partkey") / 40) % 25).cast("int").alias("iy")]
    return p.groupBy(*cell).agg(F.round(F.avg(F.when(F.col("p_size") < 4, -9999).otherwise(F.col("p_size"))), 6).alias("z"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places of the line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((990 + F.col("l_quantity") * 4.3).alias("x"), (1995 + F.col("l_discount") * 1300).alias("y"), F.col("l_quantity").cast("int").alias("q"), F.rint(F.col("l_discount") * 100).cast("int").alias("d")).distinct().withColumn("id", F.col("q") * 100 + F.col("d"))


PLACES_SQL = "SELECT DISTINCT CAST(l_quantity AS INTEGER) * 100 + CAST(round_even(l_discount * 100, 0) AS INTEGER) AS id, 990 + l_quantity * 4.3::DOUBLE AS x, 1995 + l_discount * 1300 AS y FROM lineitem"


@query(
    "dem_window",
    f"SELECT ix, CAST(24 - iy AS INTEGER) AS iy, 1000 + ix * 5.0::DOUBLE AS x, 2000 + (24 - iy) * 5.0::DOUBLE AS y, CASE WHEN z <> -9999 THEN z END AS z FROM ({DEM_SQL}) WHERE 1000 + ix * 5.0 BETWEEN 1032 AND 1101 AND 2000 + (24 - iy) * 5.0 BETWEEN 2011 AND 2072",
)
def dem_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a raster whose rows count from the north."""
    return rasters.window(dem(spark, sf_dir), GRID, 1032, 2011, 1101, 2072, -9999.0, True)


@query(
    "nearest_cells",
    f"""
WITH d AS ({DEM_SQL}), p AS (SELECT id, CAST(round_even((x - 1000) / 5, 0) AS INTEGER) AS i, CAST(round_even((y - 2000) / 5, 0) AS INTEGER) AS j FROM ({PLACES_SQL}))
SELECT p.id, coalesce(a.z, 0) AS z, b.z AS clipped FROM p LEFT JOIN d a ON a.ix = p.i AND a.iy = p.j LEFT JOIN d b ON b.ix = greatest(least(p.i, 39), 0) AND b.iy = greatest(least(p.j, 24), 0)""",
)
def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the cells that points lie in: 0 off the grid, or the border's."""
    p, cells = points(spark, sf_dir).select("id", "x", "y"), dem(spark, sf_dir)
    plain = rasters.nearest(p, GRID, cells, "x", "y", "z").select("id", "z")
    clipped = rasters.nearest(p, GRID, cells, "x", "y", "z", None, True).select("id", F.col("z").alias("clipped"))
    return plain.join(clipped, "id")


@query(
    "bilinear_heights",
    f"""
WITH d AS (SELECT * FROM ({DEM_SQL}) WHERE z <> -9999), p AS (SELECT id, (x - 1000) / 5 AS fx, (y - 2000) / 5 AS fy FROM ({PLACES_SQL})),
c AS (SELECT id, fx, fy, least(floor(fx), 38) AS i, least(floor(fy), 23) AS j FROM p WHERE fx BETWEEN 0 AND 39 AND fy BETWEEN 0 AND 24)
SELECT p.id, round(a.z * (1 - (c.fx - i)) * (1 - (c.fy - j)) + b.z * (c.fx - i) * (1 - (c.fy - j)) + e.z * (1 - (c.fx - i)) * (c.fy - j) + f.z * (c.fx - i) * (c.fy - j), 6) AS z
FROM p LEFT JOIN c ON c.id = p.id LEFT JOIN d a ON a.ix = i AND a.iy = j LEFT JOIN d b ON b.ix = i + 1 AND b.iy = j LEFT JOIN d e ON e.ix = i AND e.iy = j + 1 LEFT JOIN d f ON f.ix = i + 1 AND f.iy = j + 1""",
)
def bilinear_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = dem(spark, sf_dir).filter("z <> -9999")
    return rasters.bilinear(points(spark, sf_dir).select("id", "x", "y"), GRID, cells, "id", "x", "y").withColumn("z", F.round("z", 6))


DENSITY_SQL = f"SELECT frame, v AS i, u AS j, k, max(d) AS density FROM (SELECT frame, v, u, CAST(floor(abs(value) * 10) AS INTEGER) AS k, round(abs(value), 6) AS d FROM ({PX_SQL})) GROUP BY ALL"


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = all_pixels(spark, sf_dir).select("frame", F.col("v").alias("i"), F.col("u").alias("j"), F.floor(F.abs("value") * 10).cast("int").alias("k"), F.round(F.abs("value"), 6).alias("d"))
    return px.groupBy("frame", "i", "j", "k").agg(F.max("d").alias("density"))


@query(
    "optical_depth",
    f"""
WITH x AS ({DENSITY_SQL}), r AS (SELECT frame, i, j, k, CAST(round_even(i + (s + 0.5) * 0.6::DOUBLE, 0) AS INTEGER) AS a, CAST(round_even(j, 0) AS INTEGER) AS b, CAST(round_even(k + (s + 0.5) * 0.8::DOUBLE, 0) AS INTEGER) AS c FROM x, range(6) t(s) WHERE density > 1e-6)
SELECT r.frame, r.i, r.j, r.k, round(coalesce(sum(x.density), 0) * 2, 5) AS tau FROM r LEFT JOIN x ON x.frame = r.frame AND x.i = a AND x.j = b AND x.k = c GROUP BY ALL""",
)
def optical_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density between each voxel and the sun."""
    return rasters.optical_depth(density(spark, sf_dir), ["frame"], (0.6, 0.0, 0.8), 2.0, 6).withColumn("tau", F.round("tau", 5))


@query(
    "rays_through_gas",
    f"""
WITH x AS ({DENSITY_SQL}), g AS (SELECT frame, i, j, k FROM x WHERE density > 0.2),
r AS (SELECT frame, i, j, k, CAST(round_even(i + s * 0.6::DOUBLE, 0) AS INTEGER) AS a, j AS b, CAST(round_even(k + s * 0.8::DOUBLE, 0) AS INTEGER) AS c FROM x, (SELECT unnest([1.0, 2.0, 3.0, 4.0]) AS s))
SELECT DISTINCT r.frame, r.i, r.j, r.k FROM r JOIN g ON g.frame = r.frame AND g.i = a AND g.j = b AND g.k = c""",
)
def rays_through_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose way to the sun crosses gas."""
    x = density(spark, sf_dir)
    return rasters.crosses(x.select("frame", "i", "j", "k").withColumnsRenamed({"i": "vi", "j": "vj", "k": "vk"}), ["frame", "vi", "vj", "vk"], ["vi", "vj", "vk"], (0.6, 0.0, 0.8), [1.0, 2.0, 3.0, 4.0], x.filter("density > 0.2").select("frame", "i", "j", "k"), ["frame"]).withColumnsRenamed({"vi": "i", "vj": "j", "vk": "k"})


def height_sql(rays: str, columns: str, more: str = "") -> str:
    """``columns`` of ``rays`` (x, y) with ``h``, the height between the four cells around; null off the grid or where one is missing."""
    return f"""
  SELECT {columns}, (a.z * (1 - (fx - i)) + b.z * (fx - i)) * (1 - (fy - j)) + (e.z * (1 - (fx - i)) + f.z * (fx - i)) * (fy - j) AS h
  FROM (SELECT *, CASE WHEN fx BETWEEN 0 AND 39 AND fy BETWEEN 0 AND 24 THEN least(floor(fx), 38) END AS i, least(floor(fy), 23) AS j FROM (SELECT *, (x - 1000) / 5 AS fx, (y - 2000) / 5 AS fy FROM {rays}) {more})
  LEFT JOIN d a ON a.ix = i AND a.iy = j LEFT JOIN d b ON b.ix = i + 1 AND b.iy = j LEFT JOIN d e ON e.ix = i AND e.iy = j + 1 LEFT JOIN d f ON f.ix = i + 1 AND f.iy = j + 1"""


#: The first step at which a ray has gone below the ground, halved 25 times.
HITS_SQL = f"""
WITH RECURSIVE d AS (SELECT ix, iy, z FROM ({DEM_SQL}) WHERE z <> -9999), p AS (SELECT id, x, y, (id // 100 - 25) / 50 AS dx, (id % 100 - 5) / 20 AS dy FROM ({PLACES_SQL})),
r AS (SELECT id, x AS x0, y AS y0, dx / n AS dx, dy / n AS dy, -1 / n AS dz FROM (SELECT *, sqrt(dx * dx + dy * dy + 1) AS n FROM p)),
s AS ({height_sql("(SELECT *, x0 + k * 2 * dx AS x, y0 + k * 2 * dy AS y FROM r, range(201) t(k))", "id, k, 150 + k * 2 * dz AS z")}),
o AS (SELECT id, k, z - h AS now, lag(z - h) OVER (PARTITION BY id ORDER BY k) AS before FROM s), c AS (SELECT id, min(k) AS k FROM o WHERE before > 0 AND before * now <= 0 GROUP BY 1),
b AS (
  SELECT id, (k - 1) * 2.0::DOUBLE AS lo, k * 2.0::DOUBLE AS hi, 0 AS n FROM c
  UNION ALL
  SELECT id, CASE WHEN coalesce(150 + m * dz - h <= 0, false) THEN lo ELSE m END, CASE WHEN coalesce(150 + m * dz - h <= 0, false) THEN m ELSE hi END, n + 1
  FROM ({height_sql("(SELECT b.id, lo, hi, n, (lo + hi) / 2 AS m, dz, x0 + (lo + hi) / 2 * dx AS x, y0 + (lo + hi) / 2 * dy AS y FROM b JOIN r ON r.id = b.id WHERE n < 25)", "id, lo, hi, n, m, dz")}))
SELECT r.id, round((lo + hi) / 2, 5) AS t, round(x0 + (lo + hi) / 2 * dx, 5) AS x, round(y0 + (lo + hi) / 2 * dy, 5) AS y, round(150 + (lo + hi) / 2 * dz, 5) AS z FROM r LEFT JOIN b ON b.id = r.id AND n = 25
"""


@query("rays_on_terrain", HITS_SQL)
def rays_on_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where rays from each place first meet the terrain."""
    rays = points(spark, sf_dir).select("id", "x", "y", F.lit(150.0).alias("z"), ((F.col("q") - 25) / 50.0).alias("dx"), ((F.col("d") - 5) / 20.0).alias("dy"), F.lit(-1.0).alias("dz"))
    cells = dem(spark, sf_dir).filter("z <> -9999")
    hits = rasters.ray_hits(rays, "id", ["x", "y", "z"], ["dx", "dy", "dz"], cells, GRID, 2.0, 400.0, crossing="down")
    return hits.select("id", *[F.round(c, 5).alias(c) for c in ("t", "x", "y", "z")])
