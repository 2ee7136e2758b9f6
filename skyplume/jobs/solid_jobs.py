"""Frames reconstructed from masks and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.jobs.geometry_jobs import PX_SQL
from skyplume.jobs.mask_jobs import all_pixels, shadow_evidence
from skyplume.jobs.registry import query
from skyplume.jobs.volume_jobs import SOLID_SQL, solid_voxels
from skyplume.operators import reconstruct

#: A grid of 10 x 10 x 14 voxels of 2 m; the camera looks north, the sun stands in the west.
SCENE = reconstruct.Scene((10, 10, 14), 1.0, 2.0, (1.0, 0.0), (0.0, 1.0))


def placed(voxels: DataFrame) -> DataFrame:
    return voxels.withColumns({"x": F.col("u") * 2.0, "y": F.col("v") * 2.0})


@query(
    "revolved_solid",
    f"""
WITH p AS (SELECT *, u * 2.0 AS x, v * 2.0 AS y FROM ({SOLID_SQL})),
l AS (SELECT frame, k, least(max(x) - min(x), max(y) - min(y)) / 2 AS radius, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM p GROUP BY ALL HAVING count(*) >= 3),
a AS (SELECT frame, CASE WHEN count(*) >= 3 THEN regr_intercept(cx, k) ELSE avg(cx) END AS ax, CASE WHEN count(*) >= 3 THEN regr_slope(cx, k) ELSE 0 END AS bx, CASE WHEN count(*) >= 3 THEN regr_intercept(cy, k) ELSE avg(cy) END AS ay, CASE WHEN count(*) >= 3 THEN regr_slope(cy, k) ELSE 0 END AS by_ FROM l GROUP BY 1)
SELECT p.frame, p.k, count(*) AS n, round(any_value(l.radius), 6) AS radius FROM p JOIN l ON l.frame = p.frame AND l.k = p.k JOIN a ON a.frame = p.frame
WHERE l.radius > 0 AND round(sqrt(pow(x - ax - bx * p.k, 2) + pow(y - ay - by_ * p.k, 2)), 9) <= l.radius GROUP BY ALL""",
)
def revolved_solid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each level lies within its circle about the axis."""
    voxels = placed(solid_voxels(spark, sf_dir))
    radius = reconstruct.levels(voxels, SCENE, ["frame"]).select("frame", "k", F.round("radius", 6).alias("radius"))
    return reconstruct.revolved(voxels, SCENE, ["frame"]).groupBy("frame", "k").agg(F.count("*").alias("n")).join(radius, ["frame", "k"])


@query(
    "columns_down_to_base",
    f"""
WITH t AS (SELECT * FROM ({SOLID_SQL}) WHERE k % 3 = 2), b AS (SELECT frame, v, u, min(k) AS b FROM ({SOLID_SQL}) WHERE (u + v + k) % 4 = 0 GROUP BY ALL),
e AS (SELECT t.frame, t.v, t.u, least(coalesce(any_value(b), min(k)), max(k)) AS lo, max(k) AS hi FROM t LEFT JOIN b ON b.frame = t.frame AND b.v = t.v AND b.u = t.u GROUP BY ALL)
SELECT frame, v, u, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS k FROM e""",
)
def columns_down_to_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with gaps, filled down to another solid's foot."""
    x = solid_voxels(spark, sf_dir)
    return reconstruct.columns_filled(x.filter("k % 3 = 2"), ["frame"], x.filter("(u + v + k) % 4 = 0"))


def grid(spark: SparkSession) -> DataFrame:
    """Voxels over sloping ground; the camera sees (k, u) folded to a frame of 8 x 8, the sun shades (v, u + k)."""
    axis = lambda n, c: spark.range(n).select(F.col("id").cast("int").alias(c))
    g = axis(10, "v").crossJoin(axis(10, "u")).crossJoin(axis(14, "k"))  # 1,400 rows: the grid itself
    inside = (F.col("u") >= 1) & (F.col("u") <= 8)
    return g.select(
        "v", "u", "k", (F.col("u") * 2.0).alias("x"), (F.col("v") * 2.0).alias("y"), (F.col("k") * 2.0 + 1).alias("z"), (F.col("v") * 0.5).alias("ground"),
        F.when(inside, F.floor(F.col("k") / 2).cast("int")).alias("cam_v"), F.when(inside, F.col("u") - 1).alias("cam_u"), F.when(F.col("v") < 8, F.col("v")).alias("sun_v"), F.when(F.col("v") < 8, (F.col("u") + F.col("k")) % 8).alias("sun_u"),
    )


@query(
    "voxels_in_gas",
    f"""
WITH g AS (SELECT v, u, k FROM range(10) a(v), range(1, 9) b(u), range(14) c(k)), m AS (SELECT frame, v, u FROM ({PX_SQL}) WHERE value > 0.03),
e AS (SELECT frame, v, u, CASE WHEN abs(value) < 0.02 OR u = 7 THEN -1 WHEN value > 0 THEN 1 ELSE 0 END AS evidence FROM ({PX_SQL}))
SELECT m.frame, count(*) AS n, count(*) FILTER (evidence <> 1) AS strict, count(*) FILTER (evidence = 0) AS permissive FROM g JOIN m ON m.v = g.k // 2 AND m.u = g.u - 1
LEFT JOIN e ON e.frame = m.frame AND e.v = g.v AND g.v < 8 AND e.u = (g.u + g.k) % 8 GROUP BY 1""",
)
def voxels_in_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels that the camera sees in gas, and how many of them the sun shows empty."""
    gas = all_pixels(spark, sf_dir).filter("value > 0.03").select("frame", "v", "u")
    rows = reconstruct.judged(reconstruct.seen_in_gas(grid(spark), gas), grid(spark), shadow_evidence(spark, sf_dir))
    return rows.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("strict").alias("strict"), F.count_if("permissive").alias("permissive"))


@query("frame_solids")
def frame_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame reconstructed: the form that was taken and what it keeps (a plain version is in the tests)."""
    gas = all_pixels(spark, sf_dir).filter("value > 0.03").select("frame", "v", "u")
    solid, summary = reconstruct.reconstructed(grid(spark), gas, shadow_evidence(spark, sf_dir), SCENE)
    top = solid.groupBy("frame").agg(F.min("k").alias("foot"), F.max("k").alias("top"))
    return summary.join(top, "frame", "left").select("frame", "mode", "n_gas", "n_base", "n", "foot", "top", F.round("retained", 6).alias("retained"), F.round("relative_height", 6).alias("relative_height"))
