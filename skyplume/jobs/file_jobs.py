"""GeoTIFF rasters and glTF hulls: written from the tables, read back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.jobs.registry import query, table
from skyplume.operators.rasters import Grid
from skyplume.sinks import geotiff as tiff_sink
from skyplume.sinks import meshes as mesh_sink
from skyplume.sources import geotiff, meshes
from skyplume.sources.files import write_files
from skyplume.sources.folder import shared

GRID = Grid(1000.0, 2000.0, 5.0, 130, 90)
#: UTM zone 19 south.
SYSTEM = 32719


def raster_files(spark: SparkSession, sf_dir: str) -> str:
    """A raster for each size class of the parts, a cell for each key; small ones have no data."""
    p = table(spark, sf_dir, "part")
    at = [(F.col("p_partkey") * 37 % 130).cast("int").alias("ix"), (F.col("p_partkey") * 53 % 90).cast("int").alias("iy")]
    cells = p.groupBy(F.concat(F.lit("dem_"), (F.col("p_size") % 3).cast("string")).alias("raster"), *at).agg(F.max(F.when(F.col("p_size") >= 4, F.col("p_size").cast("double"))).alias("z"))
    folder = shared(spark, "rasters")
    write_files(tiff_sink.rasters(cells, "raster", GRID, SYSTEM), folder)
    return folder


RASTER_SQL = """
SELECT 'dem_' || (p_size % 3) AS raster, CAST(p_partkey * 37 % 130 AS INTEGER) AS ix, CAST(p_partkey * 53 % 90 AS INTEGER) AS iy, CAST(max(CASE WHEN p_size >= 4 THEN p_size END) AS DOUBLE) AS z FROM part GROUP BY ALL"""


@query(
    "geotiff_window",
    f"""
WITH d AS ({RASTER_SQL}), r AS (SELECT DISTINCT raster FROM d),
w AS (SELECT raster, CAST(c AS INTEGER) AS c, CAST(t AS INTEGER) AS t FROM r, range(17, 96) a(c), range(20, 62) b(t))
SELECT w.raster, c - 17 AS ix, 61 - t AS iy, 1000 + c * 5.0::DOUBLE AS x, 2000 + (89 - t) * 5.0::DOUBLE AS y, z FROM w LEFT JOIN d ON d.raster = w.raster AND d.ix = c AND d.iy = 89 - t""",
)
def geotiff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of each raster, numbered from the south-west: offsets rounded down, lengths up."""
    cells = geotiff.as_grid(geotiff.read_geotiff(spark, raster_files(spark, sf_dir), (1086.0, 2135.0, 1479.0, 2345.0)))
    return cells.select(F.regexp_extract("file", r"([^/]+)\.tif$", 1).alias("raster"), "ix", "iy", "x", "y", "z")


@query(
    "geotiff_cells",
    f"SELECT raster, ix, iy, z FROM ({RASTER_SQL}) WHERE z IS NOT NULL AND 1000 + ix * 5 BETWEEN 1200 AND 1433 AND 2000 + iy * 5 > 2190",
)
def geotiff_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a box that the query's own comparisons give; blocks beyond it are not read."""
    cells = geotiff.read_geotiff(spark, raster_files(spark, sf_dir)).filter("x between 1200 and 1433 and y > 2190 and z is not null")
    return cells.select(F.regexp_extract("file", r"([^/]+)\.tif$", 1).alias("raster"), F.col("col").alias("ix"), (89 - F.col("row")).alias("iy"), "z")


@query(
    "raster_summary",
    f"SELECT raster, 11700 AS cells, count(z) AS with_data, min(z) AS least, max(z) AS most, sum(z) AS total FROM ({RASTER_SQL}) GROUP BY 1",
)
def raster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rasters."""
    cells = geotiff.read_geotiff(spark, raster_files(spark, sf_dir))
    return cells.groupBy(F.regexp_extract("file", r"([^/]+)\.tif$", 1).alias("raster")).agg(F.count("*").cast("int").alias("cells"), F.count("z").alias("with_data"), F.min("z").alias("least"), F.max("z").alias("most"), F.sum("z").alias("total"))


#: Corners (1 or 0 for each edge) and faces of a box and of a tetrahedron, turned outwards.
BOX = ([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)], [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)])
TETRA = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)])


def hull_files(spark: SparkSession, sf_dir: str) -> str:
    """A box or a tetrahedron for each part, some with a face left out, some turned inside out; eight idents."""
    p = table(spark, sf_dir, "part").select("p_partkey", *[e.cast("double").alias(n) for n, e in zip("abc", (F.col("p_size") + 12.5, 3 + F.col("p_partkey") % 7, 1 + F.col("p_partkey") % 5), strict=True)], *[(F.col(c) % m).cast("double").alias(n) for n, c, m in (("e", "p_partkey", 11), ("n", "p_size", 13))])
    points = lambda solid: F.array(*[F.array(F.col("e") + x * F.col("a"), F.col("n") + y * F.col("b"), F.lit(2.0) + z * F.col("c")) for x, y, z in solid[0]])
    faces = lambda solid, turned: F.array(*[F.array(*[F.lit(i) for i in (reversed(f) if turned else f)]) for f in solid[1]])
    is_box, turned, torn = F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 5 == 3, F.col("p_partkey") % 9 == 4
    all_faces = F.when(is_box, F.when(turned, faces(BOX, True)).otherwise(faces(BOX, False))).otherwise(F.when(turned, faces(TETRA, True)).otherwise(faces(TETRA, False)))
    hulls = p.select(
        F.concat(F.lit("hulls_"), (F.col("p_partkey") % 8).cast("string")).alias("file"), F.format_string("hull_f%05d", "p_partkey").alias("mesh"),
        F.when(is_box, points(BOX)).otherwise(points(TETRA)).alias("points"), F.when(torn, F.slice(all_faces, 1, F.size(all_faces) - 1)).otherwise(all_faces).alias("faces"),
    )
    folder = shared(spark, "hulls")
    write_files(mesh_sink.mesh_files(hulls, "file"), folder)
    return folder


def hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meshes.read_meshes(spark, hull_files(spark, sf_dir))
    return rows.withColumn("file", F.regexp_extract("file", r"([^/]+)\.\d+\.\d+\.glb$", 1))


def hull_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the series of the frames says of each hull: small parts had no shadow."""
    p = table(spark, sf_dir, "part")
    edge = 4 + F.col("p_partkey") % 3
    return p.select(F.concat(F.lit("hulls_"), (F.col("p_partkey") % 8).cast("string")).alias("file"), F.col("p_partkey").alias("frame"), F.when(F.col("p_size") < 10, "no shadow").otherwise("strict").alias("mode"), (F.col("p_partkey") / 4.0).alias("t"), (edge * edge * edge * F.col("p_size")).cast("double").alias("vol"), F.col("p_size").alias("n_vox"))


HULL_SQL = """
SELECT 'hulls_' || (p_partkey % 8) AS file, p_partkey AS frame, p_size + 12.5::DOUBLE AS a, (3 + p_partkey % 7)::DOUBLE AS b, (1 + p_partkey % 5)::DOUBLE AS c,
  p_partkey % 2 = 0 AS box, p_partkey % 9 <> 4 AS shut, (p_partkey % 11)::DOUBLE AS e, (p_size % 13)::DOUBLE AS n, CASE WHEN p_size < 10 THEN 'no shadow' ELSE 'strict' END AS mode FROM part"""
HEIGHT_SQL = f"""
SELECT file, frame, e + a * f AS east, n + b * f AS north, 2 + c * f AS up, 2 + c AS top, 102 + c * f AS z, mode = 'strict' OR NOT bool_or(mode = 'strict') OVER (PARTITION BY file) AS confident
FROM (SELECT *, CASE WHEN box THEN 0.5 ELSE 0.25 END::DOUBLE AS f FROM ({HULL_SQL}))"""


@query("hull_heights", f"SELECT file, frame, round(east, 6) AS east, round(north, 6) AS north, round(up, 6) AS up, top, round(z, 6) AS z, confident FROM ({HEIGHT_SQL})")
def hull_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and tops of the hulls, and whether the series trusts them."""
    out = meshes.hull_heights(hulls(spark, sf_dir), "file", 100.0, hull_series(spark, sf_dir))
    return out.select("file", "frame", *[F.round(c, 6).alias(c) for c in ("east", "north", "up")], "top", F.round("z", 6).alias("z"), "confident")


@query(
    "hull_profile",
    f"""
WITH m AS (SELECT *, CASE WHEN box THEN 0.5 ELSE 0.25 END::DOUBLE AS f, CASE WHEN box THEN 1 / 12.0 ELSE 3 / 80.0 END::DOUBLE AS q, CASE WHEN box THEN 0 ELSE -1 / 80.0 END::DOUBLE AS r FROM ({HULL_SQL}) WHERE shut),
s AS (SELECT 'hulls_' || (p_partkey % 8) AS file, median((4 + p_partkey % 3)::DOUBLE) AS step FROM part GROUP BY 1),
v AS (SELECT m.*, step, q * a * a AS see, q * b * b AS snn, r * a * b AS sen, sqrt(q) * c AS vertical, sin(radians(60.0::DOUBLE)) AS s, cos(radians(60.0::DOUBLE)) AS k FROM m JOIN s USING (file)),
w AS (SELECT *, 90 - degrees(atan2(2 * sen, see - snn)) / 2 AS az FROM v)
SELECT file, frame, frame / 4.0::DOUBLE AS t, round(a * b * c / CASE WHEN box THEN 1 ELSE 6 END, 5) AS volume, round(e + a * f, 6) AS east, round(n + b * f, 6) AS north, round(2 + c * f, 6) AS up, 2 + c AS top,
  round(sqrt(s * s * see + 2 * s * k * sen + k * k * snn), 6) AS along, round(sqrt(k * k * see - 2 * s * k * sen + s * s * snn), 6) AS across, round(vertical, 6) AS vertical, round(((az % 180) + 180) % 180, 5) AS azimuth, vertical >= 1.5 * step AS resolved FROM w""",
)
def hull_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes and spreads of the closed hulls along and across the wind."""
    out = meshes.hull_profile(hulls(spark, sf_dir), "file", 60.0, hull_series(spark, sf_dir))
    six = lambda *names: [F.round(c, 6).alias(c) for c in names]
    return out.select("file", "frame", "t", F.round("volume", 5).alias("volume"), *six("east", "north", "up"), "top", *six("along", "across", "vertical"), F.round("azimuth", 5).alias("azimuth"), "resolved")


@query(
    "hull_height_at_frames",
    f"""
WITH h AS (SELECT * FROM ({HEIGHT_SQL}) WHERE confident), f AS (SELECT 'hulls_' || (p_partkey % 8) AS file, p_partkey + p_size % 5 AS frame FROM part GROUP BY ALL),
a AS (SELECT f.file, f.frame, h.frame AS fa, h.z AS za FROM f ASOF LEFT JOIN h ON f.file = h.file AND f.frame >= h.frame),
b AS (SELECT a.*, h.frame AS fb, h.z AS zb FROM a ASOF LEFT JOIN h ON a.file = h.file AND a.frame <= h.frame)
SELECT file, frame, round(CASE WHEN fa IS NULL THEN zb WHEN fb IS NULL OR fb = fa THEN za ELSE za + (frame - fa) / (fb - fa) * (zb - za) END, 6) AS z FROM b""",
)
def hull_height_at_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights between the confident frames."""
    heights = meshes.hull_heights(hulls(spark, sf_dir), "file", 100.0, hull_series(spark, sf_dir))
    frames = table(spark, sf_dir, "part").select(F.concat(F.lit("hulls_"), (F.col("p_partkey") % 8).cast("string")).alias("file"), (F.col("p_partkey") + F.col("p_size") % 5).alias("frame")).distinct()
    return meshes.last_confident(frames, heights, "file").withColumn("z", F.round("z", 6))
