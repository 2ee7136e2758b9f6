"""What the sun and the camera reach: shade of the terrain, hidden places, shadows of gas, the corridor where they can fall.

Rays towards the sun do not walk the ground step by step. The terrain's cells
are summed up in blocks by their greatest height; a stretch of a ray goes on only
where it dips below the heights of the blocks it crosses, is cut into finer
stretches over finer blocks, and only what is left is compared with the ground.
Each level is an equi-join of stretches with blocks, so neither the ground nor the
rays have to fit into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera, box_span
from skyplume.functions.guards import finite
from skyplume.operators.masks import dilate
from skyplume.operators.rasters import Grid, bilinear, ray_hits


def block_tops(cells: DataFrame, size: int) -> DataFrame:
    """(bi, bj, top): the greatest height of blocks of ``size`` cells."""
    at = [F.floor(F.col(c) / size).cast("int").alias(n) for c, n in (("ix", "bi"), ("iy", "bj"))]
    return cells.select(*at, finite(F.col("z")).alias("z")).groupBy("bi", "bj").agg(F.max("z").alias("top")).filter("top is not null")


def shaded(points: DataFrame, ident: str, place: list[str], sun: tuple[float, float, float], cells: DataFrame, grid: Grid, reach: float = 1500.0, step: float = 10.0, blocks: tuple[int, ...] = (64, 8)) -> DataFrame:
    """``ident`` of the points (x, y, z in ``place``) from which the ground hides the sun.

    A point is in the shade if the ground, between its four cells, is above the ray
    at one of the places ``step`` apart, up to ``reach``; where a cell is missing
    there is no ground. ``sun`` is the unit vector towards it, above the horizon. The
    result does not depend on ``blocks`` (cells a side, falling).
    """
    if sun[2] <= 0:
        raise ValueError("the sun is not above the horizon")
    n = int(reach / step)
    x, y, z = (F.col(c) for c in place)
    rays = points.select(ident, ((x - grid.x0) / grid.res).alias("_x"), ((y - grid.y0) / grid.res).alias("_y"), z.alias("_z")).dropna()
    dx, dy, dz = (step * c / (grid.res if k < 2 else 1.0) for k, c in enumerate(sun))
    parts = rays.withColumns({"_a": F.lit(1), "_b": F.lit(n)})
    for size in blocks:
        # Stretches that cross some two blocks each way.
        m = max(1, min(n, int(size / max(abs(dx), abs(dy), 1e-9))))
        cut = F.sequence(F.col("_a"), F.col("_b"), F.lit(m))
        parts = parts.filter("_a <= _b").select(ident, "_x", "_y", "_z", F.explode(cut).alias("_a"), F.col("_b").alias("_e")).withColumn("_b", F.least(F.col("_a") + m - 1, F.col("_e"))).drop("_e")
        span = lambda c, d, f: F.floor(f(F.col(c) + F.col("_a") * d, F.col(c) + F.col("_b") * d) / size).cast("int")
        # The cell beyond a place has a share in its height.
        one = lambda c, d: F.sequence(span(c, d, F.least), F.floor((F.greatest(F.col(c) + F.col("_a") * d, F.col(c) + F.col("_b") * d) + 1) / size).cast("int"))
        crossed = parts.withColumn("bi", F.explode(one("_x", dx))).withColumn("bj", F.explode(one("_y", dy))).join(block_tops(cells, size), ["bi", "bj"])
        low = F.col("_z") + F.col("_a") * dz
        parts = crossed.filter(F.col("top") > low).select(*parts.columns).distinct()
    places = parts.select(ident, "_x", "_y", "_z", F.explode(F.sequence("_a", "_b")).alias("_k"))
    places = places.select(F.struct(ident, "_x", "_y", "_z", "_k").alias("_id"), (grid.x0 + grid.res * (F.col("_x") + F.col("_k") * dx)).alias("_px"), (grid.y0 + grid.res * (F.col("_y") + F.col("_k") * dy)).alias("_py"))
    # A ray may come by several blocks; a place is asked for once.
    ground = bilinear(places.distinct(), grid, cells, "_id", "_px", "_py")
    return ground.filter(F.col("z") > F.col("_id._z") + F.col("_id._k") * dz).select(f"_id.{ident}").distinct()


def unhidden(points: DataFrame, place: list[str], camera: Camera, depths: DataFrame, margin: float) -> DataFrame:
    """``points`` with cam_v, cam_u: the pixel each is seen at, null where it is not ahead, out of the frame, or hidden.

    Hidden is what lies ``margin`` or more behind the ground that ``depths`` (v, u,
    depth) has at the pixel; where it has none, nothing hides.
    """
    xyz = [F.col(c) for c in place]
    u, v = camera.pixel(*xyz)
    ok = camera.in_frame(u, v)
    rows = points.select("*", F.when(ok, F.rint(v).cast("int")).alias("_v"), F.when(ok, F.rint(u).cast("int")).alias("_u"), camera.depth(*xyz).alias("_depth"))
    ground = depths.select(F.col("v").alias("_gv"), F.col("u").alias("_gu"), finite(F.col("depth")).alias("_ground"))
    rows = rows.join(ground, (F.col("_v") == F.col("_gv")) & (F.col("_u") == F.col("_gu")), "left")
    seen = F.col("_v").isNotNull() & F.coalesce(F.col("_depth") < F.col("_ground") + margin, F.lit(True))
    return rows.select(*points.columns, F.when(seen, F.col("_v")).alias("cam_v"), F.when(seen, F.col("_u")).alias("cam_u"))


def looked_up(grid: DataFrame, camera: Camera, sun: tuple[float, float, float], depths: DataFrame, cells: DataFrame, ground: Grid, res: float, reach: float = 800.0) -> DataFrame:
    """Voxels (v, u, k, x, y, z, ...) with what reconstruction asks of them: cam_v, cam_u and sun_v, sun_u.

    The first is the pixel that sees the voxel, the second the one that sees the
    ground in its shadow, found by casting it along the sunlight; null where the
    terrain hides them (by one and a half voxels), or they fall outside the frame.
    """
    seen = unhidden(grid, ["x", "y", "z"], camera, depths, 1.5 * res)
    text = F.concat_ws(",", "v", "u", "k")
    rays = grid.select(text.alias("voxel"), "x", "y", "z", *[F.lit(-float(c)).alias(f"d{n}") for n, c in zip("xyz", sun, strict=True)])
    hits = ray_hits(rays, "voxel", ["x", "y", "z"], ["dx", "dy", "dz"], cells, ground, res, reach, halvings=20).filter("t is not null")
    shade = unhidden(hits, ["x", "y", "z"], camera, depths, 1.5 * res).select(F.col("voxel").alias("_voxel"), F.col("cam_v").alias("sun_v"), F.col("cam_u").alias("sun_u"))
    return seen.withColumn("_text", text).join(shade, F.col("_text") == F.col("_voxel"), "left").drop("_text", "_voxel")


def cast_shadow(pixels: DataFrame, solid: DataFrame, keys: list[str], origin: tuple[float, float, float], shape: tuple[int, int, int], res: float, sun: tuple[float, float, float], stride: int = 1, step: float | None = None, reach: float = 700.0) -> DataFrame:
    """(keys, v, u): pixels whose ground (v, u, x, y, z) lies in the shadow of ``solid`` (keys, v, u, k).

    Voxel (v, u, k) is centred at ``origin`` + res * (u, v, k); the grid has ``shape``
    (v, u, k). The way to the sun is looked at every ``step`` (0.6 voxels), within the grid's box
    only. With a ``stride`` every so many pixels are asked and stand for their square.
    """
    step = step or 0.6 * res
    asked = pixels.filter((F.col("v") % stride == 0) & (F.col("u") % stride == 0)).dropna(subset=["x", "y", "z"])
    sides = (shape[1], shape[0], shape[2])
    low, high = [o - res for o in origin], [o + res * n for o, n in zip(origin, sides, strict=True)]
    enters, leaves = box_span([F.col(c) for c in "xyz"], [F.lit(float(c)) for c in sun], low, high)
    first, last = F.greatest(F.floor(enters / step), F.lit(1)).cast("int"), F.least(F.ceil(leaves / step), F.lit(int(reach / step))).cast("int")
    rows = asked.select("v", "u", "x", "y", "z", first.alias("_a"), last.alias("_b")).filter("_a <= _b")
    rows = rows.select("v", "u", "x", "y", "z", F.explode(F.sequence("_a", "_b")).alias("_k"))
    cell = lambda c, o, d: F.rint((F.col(c) + F.col("_k") * (step * d) - o) / res).cast("int")
    cells = [cell(c, o, d).alias(n) for c, o, d, n in zip("xyz", origin, sun, ("_su", "_sv", "_sk"), strict=True)]
    there = solid.select(*keys, *[F.col(c).alias(f"_s{c}") for c in "vuk"])
    dark = rows.select("v", "u", *cells).distinct().join(there, ["_sv", "_su", "_sk"]).select(*keys, "v", "u").distinct()
    if stride == 1:
        return dark
    square = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(stride) for b in range(stride)])
    grown = dark.withColumn("_s", F.explode(square)).select(*keys, (F.col("v") + F.col("_s.a")).alias("v"), (F.col("u") + F.col("_s.b")).alias("u"))
    return grown.join(pixels.select("v", "u"), ["v", "u"], "left_semi").select(*keys, "v", "u")


def corridor(pixels: DataFrame, camera: Camera, sun: tuple[float, float, float], highest: float = 160.0, step: float = 6.0) -> DataFrame:
    """(v, u, gas_v, gas_u): for each ground pixel the pixels in which the camera sees the way from there to the sun, up to ``highest``."""
    n = math.ceil(highest / max(sun[2], 1e-6) / step)
    rows = pixels.dropna(subset=["x", "y", "z"]).select("v", "u", "x", "y", "z", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k"))
    u, v = camera.pixel(*[F.col(c) + F.col("_k") * (step * d) for c, d in zip("xyz", sun, strict=True)])
    return rows.filter(camera.in_frame(u, v)).select("v", "u", F.rint(v).cast("int").alias("gas_v"), F.rint(u).cast("int").alias("gas_u")).distinct()


def column_shadow(shadow: DataFrame, gas: DataFrame, static: DataFrame, ways: DataFrame, height: int, width: int, static_reach: int = 5, gas_reach: int = 3) -> DataFrame:
    """Pixels of ``shadow`` (frame, v, u) that the column can have cast: on the ``corridor`` of the frame's gas, and neither near the gas nor near ``static`` shadow (v, u)."""
    allowed = ways.join(gas.select("frame", F.col("v").alias("gas_v"), F.col("u").alias("gas_u")), ["gas_v", "gas_u"]).select("frame", "v", "u").distinct()
    fixed = dilate(static.select(F.lit(0).alias("frame"), "v", "u"), static_reach, height, width, "ellipse").select("v", "u")
    left = shadow.join(allowed, ["frame", "v", "u"], "left_semi").join(dilate(gas, gas_reach, height, width, "ellipse"), ["frame", "v", "u"], "left_anti")
    return left.join(fixed, ["v", "u"], "left_anti").select("frame", "v", "u")


def seen_agreement(predicted: DataFrame, observed: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area_predicted, area_observed, iou, of_observed, of_predicted) on the pixels ``valid`` (keys, v, u); keys without a pixel on either side are left out."""
    on = [*keys, "v", "u"]
    both = predicted.select(*on, F.lit(1).alias("p"), F.lit(0).alias("o")).union(observed.select(*on, F.lit(0), F.lit(1))).join(valid.select(*on), on, "left_semi")
    per = both.groupBy(*on).agg(F.max("p").alias("p"), F.max("o").alias("o"))
    hit: Column = F.sum(F.col("p") * F.col("o"))
    share = lambda c: hit / F.greatest(F.sum(c), F.lit(1))
    return per.groupBy(*keys).agg(F.sum("p").alias("area_predicted"), F.sum("o").alias("area_observed"), (hit / F.count("*")).alias("iou"), share("o").alias("of_observed"), share("p").alias("of_predicted"))
