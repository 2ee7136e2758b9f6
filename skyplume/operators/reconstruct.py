"""A frame's solid from its gas mask and the sun's evidence: carved, closed by revolution, capped by its shadow.

``grid`` has a row a voxel: (v, u, k, x, y, z, ground, cam_v, cam_u, sun_v,
sun_u): its place, the terrain's height below it, the pixel that the camera sees
it at and the pixel of the ground that it would shade; pixels are null where it
is hidden or falls outside the frame. Level k lies at ``z0 + k * res``. Voxels of
frames are (keys, v, u, k). All steps but the morphology of a frame, which is
bounded by its grid, are joins and aggregates over all frames at once; the carved
forms of a frame go through them side by side, told apart by ``mode``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.operators.rasters import Grid, ray_hits
from skyplume.operators.images import held
from skyplume.operators.volumes import regularized
from skyplume.sources.folder import settled

STRICT, PERMISSIVE, NO_SHADOW = "strict", "permissive", "no shadow"


@dataclass(frozen=True)
class Scene:
    """Shape of the grid (v, u, k), height of level 0, edge of a voxel, and the horizontal normals of the lines of sight from the camera and to the sun."""

    shape: tuple[int, int, int]
    z0: float
    res: float
    across_camera: tuple[float, float]
    across_sun: tuple[float, float]


def sight_normals(camera: Camera, sun: tuple[float, float, float]) -> tuple[tuple[float, float], tuple[float, float]]:
    """Horizontal unit normals of the camera's central ray and of the direction to the sun."""
    ahead = np.array([a[2] for a in camera.axes[:2]])
    away = -np.array(sun[:2])
    return tuple(tuple((np.array([-d[1], d[0]]) / np.hypot(*d)).tolist()) for d in (ahead, away))


def seen_in_gas(grid: DataFrame, gas: DataFrame) -> DataFrame:
    """(frame, v, u, k) of the voxels that the camera sees at a pixel of ``gas`` (frame, v, u)."""
    pixels = gas.select("frame", F.col("v").alias("cam_v"), F.col("u").alias("cam_u")).distinct()
    return grid.select("v", "u", "k", "cam_v", "cam_u").join(pixels, ["cam_v", "cam_u"]).select("frame", "v", "u", "k")


def judged(voxels: DataFrame, grid: DataFrame, evidence: DataFrame) -> DataFrame:
    """``voxels`` (with a frame) with their places, and ``strict`` and ``permissive``: whether the sun shows them empty.

    Strictly, where their ground pixel is known not to be in the column's shadow
    (``evidence`` other than 1), permissively, where it is lit (0). Without a ground
    pixel or evidence a voxel may be full.
    """
    rows = voxels.join(grid.select("v", "u", "k", "x", "y", "z", "ground", "sun_v", "sun_u"), ["v", "u", "k"])
    told = evidence.select("frame", F.col("v").alias("sun_v"), F.col("u").alias("sun_u"), "evidence")
    rows = rows.join(told, ["frame", "sun_v", "sun_u"], "left").drop("sun_v", "sun_u")
    return rows.select("*", F.coalesce(F.col("evidence") != 1, F.lit(False)).alias(STRICT), F.coalesce(F.col("evidence") == 0, F.lit(False)).alias(PERMISSIVE)).drop("evidence")


def levels(voxels: DataFrame, scene: Scene, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, k, radius, cx, cy) of the levels with ``least`` voxels: half the smaller of the extents across both lines of sight, and the centre of both."""
    (a, b), (c, d) = scene.across_camera, scene.across_sun
    det = a * d - b * c
    rows = voxels.select(*keys, "k", (F.col("x") * a + F.col("y") * b).alias("_a"), (F.col("x") * c + F.col("y") * d).alias("_b"))
    g = rows.groupBy(*keys, "k").agg(F.count("*").alias("_n"), *[f(p).alias(f"{p}{n}") for p in ("_a", "_b") for n, f in (("0", F.min), ("1", F.max))]).filter(F.col("_n") >= least)
    p, q = ((F.col(f"{n}0") + F.col(f"{n}1")) / 2 for n in ("_a", "_b"))
    return g.select(*keys, "k", (F.least(F.col("_a1") - F.col("_a0"), F.col("_b1") - F.col("_b0")) / 2).alias("radius"), ((p * d - q * b) / det).alias("cx"), ((q * a - p * c) / det).alias("cy"))


def axes(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ax, bx, ay, by): the axis of the levels, x = ax + bx * k: a line through three centres or more, else straight up at their mean."""
    fit = lambda c: (F.regr_intercept(c, "k"), F.regr_slope(c, "k"))
    line = F.count("*") >= 3
    return found.groupBy(*keys).agg(*[x for c in ("x", "y") for i, s in [fit(f"c{c}")] for x in (F.when(line, i).otherwise(F.avg(f"c{c}")).alias(f"a{c}"), F.when(line, s).otherwise(0.0).alias(f"b{c}"))])


def revolved(voxels: DataFrame, scene: Scene, keys: list[str], caps: DataFrame | None = None) -> DataFrame:
    """Of ``voxels`` (keys, v, u, k, x, y, other columns) those within their level's radius of the axis.

    ``caps`` (frame, k_top): levels above count neither for the axis nor as solid.
    What is a billionth beyond the radius lies on it.
    """
    if caps is not None:
        voxels = voxels.join(caps.select("frame", F.col("k_top").alias("_top")), "frame", "left").filter(F.col("_top").isNull() | (F.col("k") <= F.col("_top"))).drop("_top")
    found = levels(voxels, scene, keys)
    rows = voxels.join(found.select(*keys, "k", "radius"), [*keys, "k"]).join(axes(found, keys), keys)
    gap = F.sqrt(F.pow(F.col("x") - F.col("ax") - F.col("bx") * F.col("k"), 2) + F.pow(F.col("y") - F.col("ay") - F.col("by") * F.col("k"), 2))
    return rows.filter((F.col("radius") > 0) & (F.round(gap, 9) <= F.col("radius"))).select(voxels.columns)


def shadow_caps(voxels: DataFrame, scene: Scene, shadow: DataFrame, sun: tuple[float, float, float], camera: Camera, cells: DataFrame, ground: Grid, share: float = 0.25, around: int = 8, least: int = 8, reach: float = 900.0) -> DataFrame:
    """(frame, k_top, limited, no_evidence): the highest level whose shadow falls on observed shadow, for frames of ``least`` voxels or more.

    Of each level the axis and ``around`` points at half its radius are cast along
    the sunlight to the ground; a level is confirmed if ``share`` of the points that
    land within the frame lie on ``shadow`` (frame, v, u). ``limited``: no point of the next
    level lands within the frame, so that the cap is the frame's. Where no level is
    confirmed there is no evidence, and the cap is the grid's top.
    """
    n_levels = scene.shape[2]
    enough = voxels.groupBy("frame").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    found = levels(voxels.join(enough, "frame", "left_semi"), scene, ["frame"])
    every = axes(found, ["frame"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1)))).join(found.select("frame", "k", "radius"), ["frame", "k"], "left")
    angles = np.linspace(0, 2 * np.pi, around, endpoint=False)
    ring = [(0.0, 0.0), *zip(np.cos(angles).tolist(), np.sin(angles).tolist(), strict=True)]
    half = F.coalesce("radius", F.lit(0.0)) / 2
    points = F.array(*[F.struct((F.col("ax") + F.col("bx") * F.col("k") + half * x).alias("x"), (F.col("ay") + F.col("by") * F.col("k") + half * y).alias("y")) for x, y in ring])
    rays = every.select("frame", "k", F.posexplode(points).alias("m", "p")).select(
        ((F.col("frame") * n_levels + F.col("k")) * len(ring) + F.col("m")).cast("long").alias("ray"), "p.x", "p.y", (scene.z0 + scene.res * F.col("k")).alias("z"), *[F.lit(-float(c)).alias(f"d{n}") for n, c in zip("xyz", sun, strict=True)]
    )
    hits = ray_hits(rays, "ray", ["x", "y", "z"], ["dx", "dy", "dz"], cells, ground, scene.res, reach, halvings=20).filter("t is not null")
    u, v = camera.pixel(F.col("x"), F.col("y"), F.col("z"))
    level = F.floor(F.col("ray") / len(ring))
    lands = hits.select(F.floor(level / n_levels).alias("frame"), (level % n_levels).cast("int").alias("k"), u.alias("_u"), v.alias("_v")).filter(F.col("_u").isNotNull() & (F.col("_u") >= 0) & (F.col("_u") < camera.width) & (F.col("_v") >= 0) & (F.col("_v") < camera.height))
    lands = lands.select("frame", "k", F.least(F.rint("_v"), F.lit(camera.height - 1)).cast("int").alias("v"), F.least(F.rint("_u"), F.lit(camera.width - 1)).cast("int").alias("u"))
    dark = shadow.select(F.col("frame").cast("long").alias("frame"), "v", "u", F.lit(1).alias("_dark")).distinct()
    told = lands.join(dark, ["frame", "v", "u"], "left").groupBy("frame", "k").agg(F.count("*").alias("n"), F.count("_dark").alias("dark"))
    frames = every.select("frame").distinct()
    per = told.groupBy("frame").agg(F.max(F.when(F.col("dark") >= share * F.col("n"), F.col("k"))).alias("_k"), F.collect_set("k").alias("_seen"))  # a level an entry
    rows = frames.join(per, "frame", "left")
    next_seen = F.array_contains(F.coalesce("_seen", F.array().cast("array<int>")), F.col("_k") + 1)
    return rows.select("frame", F.coalesce("_k", F.lit(n_levels - 1)).alias("k_top"), F.coalesce((F.col("_k") + 1 < n_levels) & ~next_seen, F.lit(False)).alias("limited"), F.col("_k").isNull().alias("no_evidence"))


def columns_filled(voxels: DataFrame, keys: list[str], base: DataFrame | None = None) -> DataFrame:
    """(keys, v, u, k): each column of ``voxels`` filled up to its highest one, from the lowest of ``base`` (frame, v, u, k) where that has the column, else from its own."""
    ends = voxels.groupBy(*keys, "v", "u").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    if base is not None:
        ends = ends.join(base.groupBy("frame", "v", "u").agg(F.min("k").alias("_b")), ["frame", "v", "u"], "left").withColumn("lo", F.least(F.coalesce("_b", "lo"), "hi"))
    return ends.select(*keys, "v", "u", F.explode(F.sequence("lo", "hi")).alias("k"))


def sizes(voxels: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, height): voxels, and the 99 % quantile of their height over the ground; a frame is bounded by its grid."""
    over = grid.select("v", "u", "k", (F.col("z") - F.col("ground")).alias("_h"))
    return voxels.join(over, ["v", "u", "k"]).groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("_h", F.lit(0.99)).alias("height"))


def reconstructed(grid: DataFrame, gas: DataFrame, evidence: DataFrame, scene: Scene, caps=None, order: str = "after", strict: bool = True, adaptive: bool = True, least_kept: float = 0.25, least_height: float = 0.6, fill: bool = True) -> tuple[DataFrame, DataFrame]:
    """The solid of each frame of ``gas``, as (frame, mode, v, u, k), and a summary (frame, mode, n_gas, n_base, n, retained, relative_height).

    The base is what the camera alone shows: voxels in gas, cleaned, closed by
    revolution, cleaned again. The carved forms take from it what the sun shows
    empty, after the revolution or before it (``order``), and fill columns down to the
    base's foot. The strict form is taken if it keeps ``least_kept`` of the base's
    voxels and ``least_height`` of its height, else the permissive one on the same
    terms, else the base; without ``adaptive`` the first form asked for in any case.
    ``caps``: a function from the cleaned voxels with their places to (frame, k_top).
    """
    if order not in ("after", "before"):
        raise ValueError(f"order is 'after' or 'before', not {order!r}")
    grid = held(grid)
    modes = [STRICT, PERMISSIVE] if strict else [PERMISSIVE]
    modes = modes if adaptive else modes[:1]
    keys, both = ["frame"], ["frame", "mode"]
    clean = lambda v, by, opened: regularized(v, scene.shape, grid, tuple(by), open_=opened)
    seen = settled(seen_in_gas(grid, gas))
    envelope = settled(judged(clean(seen, keys, 1), grid, evidence))
    tops = settled(caps(envelope)) if caps else None
    base = settled(clean(revolved(envelope, scene, keys, tops), keys, 0))
    full = lambda rows: rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))).filter(~F.when(F.col("mode") == STRICT, F.col(STRICT)).otherwise(F.col(PERMISSIVE)))
    if order == "after":
        form = full(revolved(envelope, scene, keys, tops)).select(*both, "v", "u", "k")
    else:
        carved = judged(clean(full(judged(seen, grid, evidence)), both, 1), grid, evidence)
        form = clean(revolved(carved, scene, both, tops), both, 0)
    if fill:
        form = columns_filled(form, both, base).join(grid.select("v", "u", "k"), ["v", "u", "k"], "left_semi")
    if fill or order == "after":
        form = clean(form, both, 0)
    form = settled(form)
    first = sizes(base, grid, keys).select("frame", F.col("n").alias("n_base"), F.col("height").alias("h_base"))
    told = seen.groupBy("frame").agg(F.count("*").alias("n_gas")).join(first, "frame", "left").fillna({"n_base": 0, "h_base": 0.0})
    tried = told.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes]))).join(sizes(form, grid, both), both, "left").fillna({"n": 0, "height": 0.0})
    enough = (F.col("n") >= least_kept * F.greatest("n_base", F.lit(1))) & (F.col("height") >= least_height * F.col("h_base"))
    place = F.when(F.col("mode") == modes[0], 0).otherwise(1)
    best = tried.filter(enough if adaptive else F.lit(True)).groupBy("frame").agg(F.min_by(F.struct("mode", "n", "height"), place).alias("_b"))
    chosen = settled(told.join(best, "frame", "left").select("frame", F.coalesce("_b.mode", F.lit(NO_SHADOW)).alias("mode"), "n_gas", "n_base", F.coalesce("_b.n", "n_base").alias("n"), "h_base", F.coalesce("_b.height", "h_base").alias("_h")))
    solid = form.join(chosen.select("frame", "mode"), both, "left_semi").select(*both, "v", "u", "k")
    solid = solid.union(base.join(chosen.filter(F.col("mode") == NO_SHADOW).select("frame", "mode"), "frame").select(*both, "v", "u", "k"))
    summary = chosen.select("frame", "mode", "n_gas", "n_base", "n", (F.col("n") / F.greatest("n_base", F.lit(1))).alias("retained"), (F.col("_h") / F.greatest("h_base", F.lit(1e-9))).alias("relative_height"))
    return solid, summary
