"""Which way a camera looked: the map seen by a camera turned to each of some angles, against what it did see.

For each angle rays of the picture's pixels meet the terrain, the map's cell there
gives the grey level, and the picture so made is compared with the one observed:
both as differences of two blurs, which keeps shapes and drops brightness, and at all
small shifts, of which the best counts. Angles are rows, so they run side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.operators.frames import array_of, gaussian_kernel
from skyplume.operators.rasters import Grid, nearest, ray_hits


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur; beyond the border the picture is mirrored."""
    reach = max(1, math.ceil(4 * sigma))
    k = gaussian_kernel(sigma, reach)
    for axis in (0, 1):
        wide = np.pad(a, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
        a = sum(w * np.take(wide, np.arange(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    return a


def shapes(a: np.ndarray, fine: float = 2.0, coarse: float = 14.0) -> np.ndarray:
    """Difference of two blurs; what is missing takes the mean."""
    a = np.where(np.isfinite(a), a, np.nanmean(a) if np.isfinite(a).any() else 0.0)
    return blurred(a, fine) - blurred(a, coarse)


def best_correlation(picture: np.ndarray, template: np.ndarray) -> float:
    """The greatest normalised correlation of ``template`` with the windows of ``picture`` that are as large."""
    h, w = template.shape
    t = template - template.mean()
    size = [a + b - 1 for a, b in zip(picture.shape, t.shape, strict=True)]
    valid = np.s_[h - 1 : picture.shape[0], w - 1 : picture.shape[1]]
    product = np.fft.irfft2(np.fft.rfft2(picture, size) * np.fft.rfft2(t[::-1, ::-1], size), size)[valid]

    def sums(a: np.ndarray) -> np.ndarray:
        c = np.pad(a, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
        return c[h:, w:] - c[:-h, w:] - c[h:, :-w] + c[:-h, :-w]

    spread = np.maximum(sums(picture * picture) - sums(picture) ** 2 / (h * w), 0)
    norm = np.sqrt(spread * (t * t).sum())
    found = np.divide(product, norm, out=np.zeros_like(product), where=norm > 1e-9 * max(1.0, float((t * t).sum())))
    return float(found.max())


def pixel_rays(spark: SparkSession, camera: Camera, yaws: list[float], pitch: float, stride: int) -> DataFrame:
    """(ray, yaw, v, u, x, y, z, dx, dy, dz): a ray for every ``stride``-th pixel and angle."""
    high, wide = -(-camera.height // stride), -(-camera.width // stride)
    n = high * wide
    at = spark.range(n * len(yaws)).select(F.col("id").alias("ray"), F.element_at(F.array(*[F.lit(float(y)) for y in yaws]), (F.floor(F.col("id") / n) + 1).cast("int")).alias("yaw"), F.floor(F.col("id") % n / wide).cast("int").alias("v"), (F.col("id") % wide).cast("int").alias("u"))
    y, p = F.radians("yaw"), math.radians(pitch)
    a, b = (F.col("u") * stride - camera.cx) / camera.focal, (F.col("v") * stride - camera.cy) / camera.focal
    ahead = [F.sin(y) * math.cos(p), F.cos(y) * math.cos(p), F.lit(math.sin(p))]
    right, down = [F.cos(y), -F.sin(y), F.lit(0.0)], [F.sin(y) * math.sin(p), F.cos(y) * math.sin(p), F.lit(-math.cos(p))]
    return at.select("ray", "yaw", "v", "u", *[F.lit(c).alias(n) for c, n in zip(camera.centre, "xyz", strict=True)], *[(r * a + d * b + f).alias(f"d{n}") for r, d, f, n in zip(right, down, ahead, "xyz", strict=True)])


def seen_map(camera: Camera, yaws: list[float], pitch: float, stride: int, chart: DataFrame, chart_grid: Grid, cells: DataFrame, ground: Grid, step: float = 8.0, reach: float = 2500.0) -> DataFrame:
    """(yaw, v, u, value): the map ``chart`` (ix, iy, value) as the camera would see it turned to each of ``yaws`` (degrees); pixels whose ray meets no ground are left out."""
    rays = pixel_rays(cells.sparkSession, camera, yaws, pitch, stride)
    hits = ray_hits(rays, "ray", ["x", "y", "z"], ["dx", "dy", "dz"], cells, ground, step, reach, start=step, crossing="down", halvings=24).filter("t is not null")
    shown = nearest(hits.select(F.col("ray").alias("_ray"), "x", "y"), chart_grid, chart, "x", "y", "value", None, True).filter("value is not null")
    return rays.select("ray", "yaw", "v", "u").join(shown, F.col("ray") == F.col("_ray")).select("yaw", "v", "u", "value")


def yaw_scores(pictures: DataFrame, observed: DataFrame, height: int, width: int, margin: int = 22, fine: float = 2.0, coarse: float = 14.0) -> DataFrame:
    """(yaw, correlation): each of ``pictures`` (yaw, v, u, value) against ``observed`` (v, u, value) without its ``margin``, at the best of all shifts within it."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.table({"yaw": table.column("yaw").slice(0, 1), "pixels": pa.array([array_of(table, height, width).tobytes()], pa.binary())})

    whole = lambda px: px.select("yaw", *[F.col(c).cast("int").alias(c) for c in "vu"], F.col("value").cast("double").alias("value")).groupBy("yaw").applyInArrow(pack, "yaw double, pixels binary")

    def run(batches):
        for b in batches:
            array = lambda k, i, b=b: shapes(np.frombuffer(b.column(k)[i].as_py()).reshape(height, width), fine, coarse)
            inner = np.s_[margin : height - margin, margin : width - margin]
            found = [best_correlation(array(1, i), array(2, i)[inner]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["yaw", "correlation"])

    back = whole(observed.withColumn("yaw", F.lit(0.0))).select(F.col("pixels").alias("seen"))  # one picture
    return whole(pictures).join(F.broadcast(back)).select("yaw", "pixels", "seen").mapInArrow(run, "yaw double, correlation double")


def best_yaw(scores: DataFrame) -> DataFrame:
    """(yaw, correlation, refined): the angle of the greatest correlation, and the top of the parabola through it and its neighbours; at the ends of the sweep the angle itself."""
    every = W.orderBy("yaw")  # a row an angle
    rows = scores.withColumns({"_a": F.lag("correlation").over(every), "_b": F.lead("correlation").over(every), "_l": F.lag("yaw").over(every), "_r": F.lead("yaw").over(every)})
    top = rows.agg(F.max_by(F.struct("yaw", "correlation", "_a", "_b", "_l", "_r"), F.struct(F.col("correlation"), -F.col("yaw"))).alias("_t")).select("_t.*")
    bend = F.col("_a") - 2 * F.col("correlation") + F.col("_b")
    move = F.when(bend < 0, (F.col("_a") - F.col("_b")) / (2 * bend) * (F.col("_r") - F.col("_l")) / 2)
    return top.filter("yaw is not null").select("yaw", "correlation", (F.col("yaw") + F.coalesce(move, F.lit(0.0))).alias("refined"))
