"""Silhouettes of voxels and cleaned volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.jobs.geometry_jobs import PX_SQL
from skyplume.jobs.mask_jobs import all_pixels
from skyplume.jobs.registry import query, table
from skyplume.operators import volumes

BOXES_SQL = "SELECT l_suppkey, CAST(l_quantity AS INTEGER) - 5 AS v0, CAST(l_quantity AS INTEGER) + l_linenumber * 3 AS v1, CAST(l_discount * 100 AS INTEGER) * 6 - 3 AS u0, CAST(l_discount * 100 AS INTEGER) * 6 + CAST(l_tax * 100 AS INTEGER) AS u1 FROM lineitem"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each line item, some beyond the frame."""
    q, d = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", (q - 5).alias("v0"), (q + F.col("l_linenumber") * 3).cast("int").alias("v1"), (d * 6 - 3).alias("u0"), (d * 6 + F.round(F.col("l_tax") * 100).cast("int")).alias("u1"))


@query(
    "box_silhouette",
    f"SELECT DISTINCT l_suppkey, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u FROM (SELECT l_suppkey, unnest(range(greatest(v0, 0), least(v1, 59) + 1)) AS v, u0, u1 FROM ({BOXES_SQL})), range(64) r(u) WHERE u BETWEEN u0 AND u1",
)
def box_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels under boxes through a difference array, against the boxes unrolled; bands of 16 rows."""
    return volumes.silhouette(boxes(spark, sf_dir), ["l_suppkey"], 60, 64, 16)


CAMERA = Camera.at(60.0, (0.0, -30.0, 12.0), 0.0, -10.0, 96, 64)


def solid_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, v, u, k): columns of voxels as high as a pixel's value, a cell away from the grid's sides."""
    px = all_pixels(spark, sf_dir).filter("abs(value) > 0.05")
    return px.select("frame", *[(F.col(c) + 1).cast("int").alias(c) for c in "vu"], F.explode(F.sequence(F.lit(1), (F.floor(F.abs("value") * 16) + 1).cast("int"))).alias("k"))


SOLID_SQL = f"SELECT DISTINCT frame, CAST(v + 1 AS INTEGER) AS v, CAST(u + 1 AS INTEGER) AS u, CAST(unnest(range(1, CAST(floor(abs(value) * 16) AS BIGINT) + 2)) AS INTEGER) AS k FROM ({PX_SQL}) WHERE abs(value) > 0.05"


def corner_sql() -> str:
    """The camera's pixel of a voxel's corner (x, y, z), as SQL."""
    part = lambda k: " + ".join(f"({a[k]!r}::DOUBLE) * ({p} - ({c!r}::DOUBLE))" for a, p, c in zip(CAMERA.axes, "xyz", CAMERA.centre, strict=True))
    return f"60 * ({part(0)}) / ({part(2)}) + 48 AS pu, 60 * ({part(1)}) / ({part(2)}) + 32 AS pv"


@query(
    "voxel_silhouette",
    f"""
WITH s AS (SELECT frame, v, u, k, (u - 4.5) * 2 + a AS x, (v - 4.5) * 2 + b AS y, k * 2 + c AS z FROM ({SOLID_SQL}), (SELECT unnest([-1.0, 1.0]) AS a) q, (SELECT unnest([-1.0, 1.0]) AS b) r, (SELECT unnest([-1.0, 1.0]) AS c) t),
p AS (SELECT frame, v, u, k, {corner_sql()} FROM s),
b AS (SELECT frame, floor(min(pv)) AS v0, ceil(max(pv)) AS v1, floor(min(pu)) AS u0, ceil(max(pu)) AS u1 FROM p GROUP BY frame, v, u, k),
d AS (SELECT DISTINCT frame, CAST(greatest(least(v0, 63), 0) AS INTEGER) AS v0, CAST(greatest(least(v1, 63), 0) AS INTEGER) AS v1, CAST(greatest(least(u0, 95), 0) AS INTEGER) AS u0, CAST(greatest(least(u1, 95), 0) AS INTEGER) AS u1 FROM b)
SELECT frame, count(*) AS area, min(v) AS top, max(v) AS bottom, sum(u) AS sum_u FROM (SELECT DISTINCT frame, v, unnest(range(u0, u1 + 1)) AS u FROM (SELECT frame, unnest(range(v0, v1 + 1)) AS v, u0, u1 FROM d)) GROUP BY frame""",
)
def voxel_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels seen by a camera: how large and where their silhouette is."""
    at = solid_voxels(spark, sf_dir).select("frame", ((F.col("u") - 4.5) * 2).alias("x"), ((F.col("v") - 4.5) * 2).alias("y"), (F.col("k") * 2.0).alias("z"))
    runs = volumes.covered_runs(volumes.voxel_boxes(at, ["frame"], CAMERA, "x", "y", "z", 2.0), ["frame"], 64, 96, 32)
    n = F.col("u1") - F.col("u0") + 1
    return runs.groupBy("frame").agg(F.sum(n).alias("area"), F.min("v").cast("long").alias("top"), F.max("v").cast("long").alias("bottom"), F.sum((F.col("u0") + F.col("u1")) * n / 2).cast("long").alias("sum_u"))


def near(rows: str, together: str, n: int) -> str:
    """Cells of the grid of which ``together`` of the seven cells in and next to them are in ``rows``."""
    return f"SELECT frame, v + dv AS v, u + du AS u, k + dk AS k FROM {rows}, n WHERE v + dv BETWEEN 0 AND 9 AND u + du BETWEEN 0 AND 9 AND k + dk BETWEEN 0 AND 13 GROUP BY ALL HAVING count(*) {together} {n}"


#: Closing, opening of frames with 60 voxels or more where that leaves some, then the largest component.
CLEAN_SQL = f"""
WITH RECURSIVE n AS (SELECT unnest([0, -1, 1, 0, 0, 0, 0]) AS dv, unnest([0, 0, 0, -1, 1, 0, 0]) AS du, unnest([0, 0, 0, 0, 0, -1, 1]) AS dk),
s AS ({SOLID_SQL}), z AS (SELECT frame, count(*) AS n_before FROM s GROUP BY 1),
c1 AS ({near("s", ">=", 1)}), c AS ({near("c1", "=", 7)}), o1 AS ({near("c", "=", 7)}), o AS ({near("o1", ">=", 1)}),
w AS (SELECT z.frame, n_before, n_before >= 60 AND EXISTS (SELECT 1 FROM o WHERE o.frame = z.frame) AS opened FROM z),
g AS (SELECT o.* FROM o JOIN w ON w.frame = o.frame AND opened UNION ALL SELECT c.* FROM c JOIN w ON w.frame = c.frame AND NOT opened),
r AS (SELECT frame, (v * 10 + u) * 14 + k AS seed, v, u, k FROM g UNION SELECT r.frame, r.seed, g.v, g.u, g.k FROM r JOIN g ON g.frame = r.frame AND abs(g.v - r.v) + abs(g.u - r.u) + abs(g.k - r.k) = 1),
l AS (SELECT frame, v, u, k, min(seed) AS c FROM r GROUP BY ALL), a AS (SELECT frame, c, count(*) AS n FROM l GROUP BY ALL),
b AS (SELECT frame, count(*) AS parts, arg_max(c, {{'n': n, 'c': -c}}) AS c FROM a GROUP BY 1)
"""


@query("cleaned_volumes", CLEAN_SQL + "SELECT w.frame, n_before, coalesce(a.n, 0) AS n_after, coalesce(parts, 0) AS n_components, opened FROM w LEFT JOIN b ON b.frame = w.frame LEFT JOIN a ON a.frame = w.frame AND a.c = b.c")
def cleaned_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How closing, opening and the choice of the largest component change each frame's voxels."""
    return volumes.cleaned_frames(solid_voxels(spark, sf_dir), (10, 10, 14), least_open=60).drop("cells")


@query("regular_voxels", CLEAN_SQL + "SELECT l.frame, l.v, l.u, l.k FROM l JOIN b ON b.frame = l.frame AND b.c = l.c WHERE (v + u) <> 9")
def regular_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels that stay, of a grid without the cells of a diagonal plane."""
    grid = spark.range(10).select(F.col("id").cast("int").alias("v")).join(spark.range(10).select(F.col("id").cast("int").alias("u")), F.col("v") + F.col("u") != 9).select("v", "u", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("k"))
    return volumes.regularized(solid_voxels(spark, sf_dir), (10, 10, 14), grid, least_open=60).select("frame", "v", "u", "k")
