"""Silhouettes of voxels, and frames of voxels cleaned by morphology.

A frame's voxels are (frame, v, u, k): cells of a grid of known shape. A frame is
bounded by its grid, and so are the arrays that tasks hold; silhouettes are cut
into bands of rows, so that a large frame is dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.operators.masks import FACES, component_labels, dilate

#: Rows of pixels that a task sums at once.
BAND = 256


def voxel_boxes(voxels: DataFrame, keys: list[str], camera: Camera, x: str, y: str, z: str, res: float) -> DataFrame:
    """(keys, v0, u0, v1, u1): the pixels that enclose the eight corners of each voxel of edge ``res`` centred at (x, y, z), cut to the frame.

    A voxel with a corner that is not ahead of the camera is left out.
    """
    half = [(sx * res / 2, sy * res / 2, sz * res / 2) for sx in (-1, 1) for sy in (-1, 1) for sz in (-1, 1)]
    rows = voxels.select(*keys, F.array(*[F.struct(*[c.alias(n) for c, n in zip(camera.pixel(F.col(x) + a, F.col(y) + b, F.col(z) + c), "uv", strict=True)]) for a, b, c in half]).alias("_p"))
    u, v = F.col("_p.u"), F.col("_p.v")
    ahead = ~F.exists("_p", lambda p: p["u"].isNull() | p["v"].isNull())
    cut = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)).cast("int")
    return rows.filter(ahead).select(*keys, cut(F.floor(F.array_min(v)), camera.height).alias("v0"), cut(F.floor(F.array_min(u)), camera.width).alias("u0"), cut(F.ceil(F.array_max(v)), camera.height).alias("v1"), cut(F.ceil(F.array_max(u)), camera.width).alias("u1"))


def runs_of(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the maximal runs of each row."""
    edge = np.diff(on.astype(np.int8), axis=1, prepend=0, append=0)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def parted(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal, and so are NaN."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.fill_null(pc.equal(a, b), False)
    same = pc.or_(same, pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    return ~same.to_numpy(zero_copy_only=False)


def covered_runs(boxes: DataFrame, keys: list[str], height: int, width: int, band: int = BAND) -> DataFrame:
    """(keys, v, u0, u1): maximal runs of pixels that any box (v0, u0, v1, u1, ends included) covers.

    A box is four corners of a difference array, whatever its area, and a band of rows
    of a frame is cumulated along both axes at once. Boxes beyond the frame are cut to it; those
    with a null or reversed bound cover nothing.
    """
    inside = boxes.filter("v0 <= v1 and u0 <= u1").filter(f"v1 >= 0 and u1 >= 0 and v0 < {height} and u0 < {width}")
    cut = inside.select(*keys, F.greatest("v0", F.lit(0)).alias("v0"), F.greatest("u0", F.lit(0)).alias("u0"), F.least("v1", F.lit(height - 1)).alias("v1"), F.least("u1", F.lit(width - 1)).alias("u1"))
    part = cut.withColumn("_b", F.explode(F.sequence(F.floor(F.col("v0") / band).cast("int"), F.floor(F.col("v1") / band).cast("int"))))
    low, high = F.greatest(F.col("v0") - F.col("_b") * band, F.lit(0)), F.least(F.col("v1") - F.col("_b") * band + 1, F.lit(band))
    part = part.select(*keys, "_b", low.cast("int").alias("_low"), high.cast("int").alias("_high"), F.col("u0").cast("int").alias("u0"), (F.col("u1") + 1).cast("int").alias("u1"))
    # One shuffle of a row a box and band; rows of a band come one after another, so that a task holds one band's array however many boxes it has.
    part = part.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b")
    names = [*keys, "_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array, last = np.zeros((band + 1, width + 1), np.int64), None

        def found(row: pa.RecordBatch) -> pa.RecordBatch:
            v, u0, u1 = runs_of(array.cumsum(axis=0).cumsum(axis=1)[:band, :width] > 0)
            first = pa.array(np.zeros(len(v), np.int64))
            columns = [row.column(k).take(first) for k in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(v + band * row.column(len(keys))[0].as_py(), pa.int32()), pa.array(u0, pa.int32()), pa.array(u1, pa.int32())], [*keys, "v", "u0", "u1"])

        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(np.concatenate(([True], np.any([parted(b.column(k)) for k in range(len(names))], axis=0)))).tolist()
            low, high, u0, u1 = (b.column(len(names) + k).to_numpy() for k in range(4))
            for i, j in zip(starts, [*starts[1:], b.num_rows], strict=True):
                here = b.slice(i, 1)
                if last is not None and any(parted(pa.concat_arrays([last.column(k), here.column(k)]))[0] for k in range(len(names))):
                    yield found(last)
                    array[:] = 0
                last = here
                for v, u, d in ((low, u0, 1), (low, u1, -1), (high, u0, -1), (high, u1, 1)):
                    np.add.at(array, (v[i:j], u[i:j]), d)
        if last is not None:
            yield found(last)

    kinds = ", ".join(f"`{k}` {boxes.schema[k].dataType.simpleString()}" for k in keys)
    return part.select(*names, "_low", "_high", "u0", "u1").mapInArrow(run, f"{kinds}, v int, u0 int, u1 int")


def silhouette(boxes: DataFrame, keys: list[str], height: int, width: int, band: int = BAND) -> DataFrame:
    """(keys, v, u) of the pixels that ``covered_runs`` has."""
    return covered_runs(boxes, keys, height, width, band).select(*keys, "v", F.explode(F.sequence("u0", "u1")).alias("u"))


def grown(solid: np.ndarray, times: int) -> np.ndarray:
    """A cell is on if it or one of its six neighbours was."""
    for _ in range(times):
        out = solid.copy()
        for axis in range(solid.ndim):
            a, b = np.moveaxis(out, axis, 0), np.moveaxis(solid, axis, 0)
            a[1:] |= b[:-1]
            a[:-1] |= b[1:]
        solid = out
    return solid


def shrunk(solid: np.ndarray, times: int) -> np.ndarray:
    """A cell stays on if all its six neighbours were; beyond the array all is off."""
    for _ in range(times):
        out = solid.copy()
        for axis in range(solid.ndim):
            a, b = np.moveaxis(out, axis, 0), np.moveaxis(solid, axis, 0)
            a[1:] &= b[:-1]
            a[:-1] &= b[1:]
            a[0] = a[-1] = False
        solid = out
    return solid


def cleaned(cells: np.ndarray, shape: tuple[int, int, int], close: int, open_: int, largest: bool, least_open: int) -> tuple[np.ndarray, int, bool]:
    """Cells (rows) after closing, opening if there are ``least_open`` or more and something stays, and the choice of the largest component; the number of components, and whether it was opened."""
    margin = close + open_ + 1
    low = np.maximum(cells.min(axis=0) - margin, 0)
    high = np.minimum(cells.max(axis=0) + margin + 1, shape)  # what is off all round needs no more room
    solid = np.zeros(high - low, bool)
    solid[tuple((cells - low).T)] = True
    solid = shrunk(grown(solid, close), close)
    opened = False
    if open_ and len(cells) >= least_open:
        smaller = grown(shrunk(solid, open_), open_)
        opened = bool(smaller.any())
        solid = smaller if opened else solid
    kept = np.argwhere(solid)
    parts = 0
    if largest and len(kept):
        label = component_labels(kept, FACES)
        seeds, sizes = np.unique(label, return_counts=True)
        parts = len(seeds)
        kept = kept[label == seeds[sizes.argmax()]]  # the first of the largest, in order of cells
    return kept + low, parts, opened


def cleaned_frames(voxels: DataFrame, shape: tuple[int, int, int], close: int = 1, open_: int = 1, largest: bool = True, least_open: int = 400, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """(keys, n_before, n_after, n_components, opened, cells): the voxels of each of ``keys`` after ``cleaned``.

    Repeated voxels are one, those beyond the grid (``shape``: v, u, k) are left
    out; a frame without any is not there. ``n_components`` is 0 where the largest
    one is not chosen.
    """
    inside = voxels.filter(" and ".join(f"{c} >= 0 and {c} < {n}" for c, n in zip("vuk", shape, strict=True)))

    def run(table: pa.Table) -> pa.Table:
        cells = np.unique(np.stack([table.column(c).to_numpy() for c in "vuk"], axis=1), axis=0)
        kept, parts, opened = cleaned(cells, shape, close, open_, largest, least_open)
        there = pa.StructArray.from_arrays([pa.array(kept[:, k], pa.int32()) for k in range(3)], list("vuk"))
        lists = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), there)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "n_before": [len(cells)], "n_after": [len(kept)], "n_components": [parts], "opened": [opened], "cells": lists})

    rows = inside.select(*keys, *[F.col(c).cast("int").alias(c) for c in "vuk"])
    kinds = ", ".join(f"`{k}` {voxels.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(run, f"{kinds}, n_before long, n_after long, n_components long, opened boolean, cells array<struct<v:int,u:int,k:int>>")


def regularized(voxels: DataFrame, shape: tuple[int, int, int], domain: DataFrame | None = None, keys: tuple[str, ...] = ("frame",), **how) -> DataFrame:
    """(keys, v, u, k): the voxels of ``cleaned_frames``; of a grid with gaps only those in ``domain`` (v, u, k)."""
    rows = cleaned_frames(voxels, shape, keys=keys, **how).select(*keys, F.explode("cells").alias("_c")).select(*keys, "_c.*")
    return rows if domain is None else rows.join(domain.select("v", "u", "k"), ["v", "u", "k"], "left_semi").select(*keys, "v", "u", "k")


def density_fields(voxels: DataFrame, shape: tuple[int, int, int], smooth: float = 1.2, top: float = 0.09, keys: tuple[str, ...] = ("frame",), least: float = 1e-6) -> DataFrame:
    """(keys, v, u, k, density): each frame's voxels blurred along the three axes, its densest cell at ``top``; cells below ``least`` are left out.

    Beyond the grid the field is mirrored. Without ``smooth`` all voxels have ``top``.
    """
    inside = voxels.filter(" and ".join(f"{c} >= 0 and {c} < {n}" for c, n in zip("vuk", shape, strict=True)))
    reach = int(4 * smooth + 0.5)
    weight = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * smooth * smooth)) if smooth > 0 else np.ones(1)
    weight = weight / weight.sum()

    def run(table: pa.Table) -> pa.Table:
        cells = np.stack([table.column(c).to_numpy() for c in "vuk"], axis=1)
        low, high = np.maximum(cells.min(axis=0) - reach, 0), np.minimum(cells.max(axis=0) + reach + 1, shape)
        field = np.zeros(high - low)
        field[tuple((cells - low).T)] = 1.0
        for axis in range(3):
            # Mirrored where the grid ends, nothing where only the crop does.
            ends = (reach, "symmetric") if low[axis] == 0 else (reach, "constant"), (reach, "symmetric") if high[axis] == shape[axis] else (reach, "constant")
            for side, (n, how) in enumerate(ends):
                field = np.pad(field, [((n, 0) if side == 0 else (0, n)) if i == axis else (0, 0) for i in range(3)], mode=how)
            n = field.shape[axis] - 2 * reach
            field = sum(w * np.take(field, np.arange(i, i + n), axis=axis) for i, w in enumerate(weight))
        field = field * (top / field.max())
        at = np.argwhere(field >= least)
        first = pa.array(np.zeros(len(at), np.int64))
        there = at + low
        return pa.table({**{k: table.column(k).combine_chunks().take(first) for k in keys}, **{c: pa.array(there[:, i], pa.int32()) for i, c in enumerate("vuk")}, "density": field[tuple(at.T)]})

    kinds = ", ".join(f"`{k}` {voxels.schema[k].dataType.simpleString()}" for k in keys)
    return inside.select(*keys, *[F.col(c).cast("int").alias(c) for c in "vuk"]).groupBy(*keys).applyInArrow(run, f"{kinds}, v int, u int, k int, density double")


def outside_grid(gas: DataFrame, seen: DataFrame, height: int, width: int, reach: int = 4) -> DataFrame:
    """(frame, share): how much of each frame's gas (frame, v, u) lies beyond the pixels in which any voxel of the grid is seen (v, u), widened by a box of ``reach``."""
    covered = dilate(seen.select(F.lit(0).alias("frame"), "v", "u").distinct(), reach, height, width).select("v", "u", F.lit(1).alias("_in"))
    return gas.join(covered, ["v", "u"], "left").groupBy("frame").agg(((F.count("*") - F.count("_in")) / F.count("*")).alias("share"))
