"""Rasters as cell tables: (ix, iy, z), cell (ix, iy) centred at (x0 + ix * res, y0 + iy * res)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyplume.functions.guards import finite


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    res: float
    nx: int
    ny: int

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Cell of a point, halves to even."""
        return F.rint((x - self.x0) / self.res).cast("int"), F.rint((y - self.y0) / self.res).cast("int")


def window(cells: DataFrame, grid: Grid, west: float, south: float, east: float, north: float, nodata: float | None = None, top_down: bool = False) -> DataFrame:
    """(ix, iy, x, y, z) of the cells whose centres lie in a box, by comparisons on the stored numbers, so that files are pruned; ``nodata`` is null.

    ``top_down`` rows are numbered from the north and come out from the south.
    """
    iy = grid.ny - 1 - F.col("iy") if top_down else F.col("iy")
    cols = [int(np.ceil((west - grid.x0) / grid.res)), int(np.floor((east - grid.x0) / grid.res))]
    rows = [int(np.ceil((south - grid.y0) / grid.res)), int(np.floor((north - grid.y0) / grid.res))]
    stored = [grid.ny - 1 - rows[1], grid.ny - 1 - rows[0]] if top_down else rows
    z = finite(F.col("z"))
    z = z if nodata is None else F.when(z != nodata, z)
    inside = cells.filter(F.col("ix").between(*cols) & F.col("iy").between(*stored))
    return inside.select("ix", iy.cast("int").alias("iy"), (grid.x0 + F.col("ix") * grid.res).alias("x"), (grid.y0 + iy * grid.res).alias("y"), z.alias("z"))


def nearest(points: DataFrame, grid: Grid, cells: DataFrame, x: str, y: str, value: str, outside: float | None = 0.0, clip: bool = False) -> DataFrame:
    """``points`` with the ``value`` of the cell they lie in; off the grid (or without a cell) ``outside``, or with ``clip`` the border's cell."""
    i, j = grid.place(F.col(x), F.col(y))
    if clip:
        i, j = (F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)) for k, n in ((i, grid.nx), (j, grid.ny)))
    rows = points.withColumns({"_i": i, "_j": j})
    inside = cells.filter(F.col("ix").between(0, grid.nx - 1) & F.col("iy").between(0, grid.ny - 1)).select(F.col("ix").alias("_i"), F.col("iy").alias("_j"), F.col(value).alias("_z"))
    return rows.join(inside, ["_i", "_j"], "left").select(*points.columns, F.coalesce("_z", F.lit(outside)).alias(value))


def bilinear(points: DataFrame, grid: Grid, cells: DataFrame, ident: str, x: str, y: str) -> DataFrame:
    """(ident, z): heights between the four cells around each point; null off the grid or where one of them has none."""
    fx, fy = (F.col(x) - grid.x0) / grid.res, (F.col(y) - grid.y0) / grid.res
    i, j = (F.least(F.floor(f), F.lit(n - 2)).cast("int") for f, n in ((fx, grid.nx), (fy, grid.ny)))
    inside = fx.between(0, grid.nx - 1) & fy.between(0, grid.ny - 1)
    rows = points.select(ident, fx.alias("_fx"), fy.alias("_fy"), i.alias("_i0"), j.alias("_j0"), inside.alias("_in"))
    wx, wy = F.col("_fx") - F.col("_i0"), F.col("_fy") - F.col("_j0")
    corner = lambda di, dj: F.struct((F.col("_i0") + di).alias("i"), (F.col("_j0") + dj).alias("j"), ((wx if di else 1 - wx) * (wy if dj else 1 - wy)).alias("w"))
    each = rows.filter("_in").select(ident, F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c")).select(ident, "c.*")
    z = each.join(cells.select(F.col("ix").alias("i"), F.col("iy").alias("j"), finite(F.col("z")).alias("_z")), ["i", "j"])
    found = z.groupBy(ident).agg(F.when(F.count("_z") == 4, F.sum(F.col("w") * F.col("_z"))).alias("z"))
    return points.select(ident).join(found, ident, "left")


#: Bytes of ground that are held at once: 8 million cells.
HELD = 64 << 20


def held(cells: DataFrame, grid: Grid, most: int = HELD) -> np.ndarray:
    """The grid as an array (iy, ix), NaN where there is no cell; its bytes are checked first."""
    if 8 * grid.nx * grid.ny > most:
        raise ValueError(f"a grid of {grid.nx} x {grid.ny} cells is more than is held at once: take a window of it")
    out = np.full((grid.ny, grid.nx), np.nan)
    rows = cells.filter(F.col("ix").between(0, grid.nx - 1) & F.col("iy").between(0, grid.ny - 1)).select("ix", "iy", finite(F.col("z")).alias("z")).toPandas()
    out[rows["iy"], rows["ix"]] = rows["z"].astype(float)
    return out


def between(z: np.ndarray, grid: Grid, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear heights; NaN off the grid."""
    fx, fy = (x - grid.x0) / grid.res, (y - grid.y0) / grid.res
    ok = (fx >= 0) & (fx <= grid.nx - 1) & (fy >= 0) & (fy <= grid.ny - 1)
    i, j = (np.clip(np.floor(np.where(ok, f, 0)).astype(int), 0, n - 2) for f, n in ((fx, grid.nx), (fy, grid.ny)))
    wx, wy = fx - i, fy - j
    out = (z[j, i] * (1 - wx) + z[j, i + 1] * wx) * (1 - wy) + (z[j + 1, i] * (1 - wx) + z[j + 1, i + 1] * wx) * wy
    return np.where(ok, out, np.nan)


def ray_hits(rays: DataFrame, ident: str, origin: list[str], direction: list[str], cells: DataFrame, grid: Grid, step: float = 5.0, reach: float = 4000.0, start: float = 0.0, crossing: str = "any", halvings: int = 25) -> DataFrame:
    """(ident, t, x, y, z): where each ray first meets the ground, or nulls.

    The ground is a bounded grid that each task holds. Rays advance by ``step``
    from ``start`` up to ``reach`` until the ray's height above the ground changes
    sign (``crossing`` 'down': from above to below only), then the place is
    halved.
    """
    z = held(cells, grid)
    ground = rays.sparkSession.sparkContext.broadcast(z)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            o, d = pdf[origin].to_numpy(float), pdf[direction].to_numpy(float)
            d = d / np.sqrt((d * d).sum(axis=1, keepdims=True))

            def over(t: np.ndarray, at: np.ndarray, o=o, d=d) -> np.ndarray:
                p = o[at] + t[:, None] * d[at]
                return p[:, 2] - between(ground.value, grid, p[:, 0], p[:, 1])

            live = np.arange(len(pdf))
            low, high = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            before = over(np.full(len(pdf), start), live)
            k = 1
            while len(live) and start + k * step <= reach:
                t = start + k * step
                now = over(np.full(len(live), t), live)
                hit = (before * now <= 0) & ((crossing == "any") | (before > 0))
                low[live[hit]], high[live[hit]] = t - step, t
                live, before = live[~hit], now[~hit]
                k += 1
            at = np.flatnonzero(~np.isnan(low))
            a, b = low[at], high[at]
            side = np.sign(over(a, at))
            side[side == 0] = 1
            for _ in range(halvings):
                m = (a + b) / 2
                past = side * over(m, at) <= 0
                a, b = np.where(past, a, m), np.where(past, m, b)
            t = np.full(len(pdf), np.nan)
            t[at] = (a + b) / 2
            p = o + t[:, None] * d
            yield pd.DataFrame({ident: pdf[ident], "t": t, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}).astype({"t": "Float64", "x": "Float64", "y": "Float64", "z": "Float64"})

    out = rays.select(ident, *origin, *direction).mapInPandas(run, f"{ident} {rays.schema[ident].dataType.simpleString()}, t double, x double, y double, z double")
    return out.select(ident, *[finite(F.col(c)).alias(c) for c in ("t", "x", "y", "z")])


def optical_depth(voxels: DataFrame, keys: list[str], direction: tuple[float, float, float], res: float, steps: int) -> DataFrame:
    """Per voxel (keys, i, j, k, density), the density from it towards ``direction`` (unit vector) in ``steps`` steps of ``res``, times the step.

    Steps are unrolled and joined to cells by their rounded place; off the volume
    the density is 0.
    """
    at = [(s + 0.5) for s in range(steps)]
    place = F.explode(F.array(*[F.struct(*[F.rint(F.col(c) + t * d).cast("int").alias(f"_{c}") for c, d in zip(("i", "j", "k"), direction, strict=True)]) for t in at])).alias("_p")
    rays = voxels.filter("density > 1e-6").select(*keys, "i", "j", "k", place).select(*keys, "i", "j", "k", "_p.*")
    there = voxels.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("i", "j", "k")], "density")
    return rays.join(there, [*keys, "_i", "_j", "_k"], "left").groupBy(*keys, "i", "j", "k").agg((F.coalesce(F.sum("density"), F.lit(0.0)) * res).alias("tau"))


def crosses(points: DataFrame, ident: list[str], origin: list[str], direction: tuple[float, float, float], steps: list[float], solid: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``points`` whose ray meets a cell of ``solid`` (keys, i, j, k) at one of ``steps``: a semi join on unrolled places."""
    place = F.explode(F.array(*[F.struct(*[F.rint(F.col(c) + t * d).cast("int").alias(n) for c, d, n in zip(origin, direction, ("i", "j", "k"), strict=True)]) for t in steps])).alias("_p")
    hit = points.select(*ident, *[c for c in keys if c not in ident], place).select(*ident, *[c for c in keys if c not in ident], "_p.*").join(solid, [*keys, "i", "j", "k"], "left_semi").select(*ident).distinct()
    return points.join(hit, ident, "left_semi")
