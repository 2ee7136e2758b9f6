"""Modes of directions by their density on the circle."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyplume.functions.guards import finite

CELLS, KAPPA = 720, 180.0


#: Keys whose densities a task holds at once.
TOGETHER = 512


def _of_counts(df: DataFrame, keys: list[str], angle: Column, kappa: float, cells: int, f: Callable[[np.ndarray, np.ndarray], list[pa.Array]], schema: str) -> DataFrame:
    """(keys, n, schema): ``f`` of the angles' numbers and the densities of some keys, as columns.

    Angles are counted by cell before anything is multiplied, so that a key is one row
    with ``cells`` counts at most whatever it holds; only these are shuffled, and the
    kernel is convolved over them in tasks, many keys at once.
    """
    x = finite(angle)
    cell = F.pmod(F.rint((x + 180) * (cells / 360)), F.lit(float(cells))).cast("int")
    counted = df.select(*keys, x.alias("_x"), cell.alias("_c")).filter("_x is not null").groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    held = counted.groupBy(*keys).agg(F.sum("_n").alias("n"), F.collect_list("_c").alias("_cells"), F.collect_list("_n").alias("_counts"))
    weight = np.array([math.exp(kappa * (math.cos(2 * math.pi * d / cells) - 1)) for d in range(cells)])
    weight[weight < 1e-12] = 0
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(cells)
        kernel = weight[(at[None, :] - at[:, None]) % cells]
        for whole in batches:
            for k in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(k, TOGETHER)
                lists, counts = b.column(len(keys) + 1), b.column(len(keys) + 2)
                row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                table = np.zeros((b.num_rows, cells))
                table[row, lists.flatten().to_numpy()] = counts.flatten().to_numpy()
                density = np.floor(table @ kernel * 1e9 + 0.5) / 1e9
                found = f(b.column(len(keys)).to_numpy(), density)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys) + 1], *found], [*keys, "n", *names])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return held.select(*keys, "n", "_cells", "_counts").mapInArrow(run, f"{fields}, n long, {schema}")


def direction_density(df: DataFrame, keys: list[str], angle: Column, kappa: float = KAPPA, cells: int = CELLS) -> DataFrame:
    """(keys, n, cell, density): a von Mises kernel summed over each key's finite angles (degrees), at ``cells`` places from -180 degrees on.

    Weights below 1e-12 are left out; densities are relative (1 for one angle in the
    cell) and rounded to nine digits, so that equal ones stay equal.
    """

    def listed(n: np.ndarray, density: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * cells, pa.int32()), pa.array(density.ravel()))]

    rows = _of_counts(df, keys, angle, kappa, cells, listed, "density array<double>")
    return rows.select(*keys, "n", F.posexplode("density").alias("cell", "density"))


def two_peaks(density: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, ...]:
    """(both, i, j, hi, lo, way, least) of the two highest peaks of each row, the later cell first of equals; ``both``: of ``some`` rows, those that have two."""
    cells, row = density.shape[1], np.arange(len(density))
    height = np.where((density > np.roll(density, 1, axis=1)) & (density >= np.roll(density, -1, axis=1)), density, -1.0)
    top = lambda: cells - 1 - np.argmax(height[:, ::-1], axis=1)
    i = top()
    hi = height[row, i]
    height[row, i] = -1.0
    j = top()
    lo = height[row, j]
    way = (j - i) % cells
    near = way <= cells - way
    start, length = np.where(near, i, j), np.where(near, way, cells - way)
    inside = (np.arange(cells)[None, :] - start[:, None]) % cells <= length[:, None]
    return some & (lo >= 0), i, j, hi, lo, way, np.where(inside, density, np.inf).min(axis=1)


def density_modes(df: DataFrame, keys: list[str], angle: Column, kappa: float = KAPPA, cells: int = CELLS, least: int = 100, dip: float = 0.30, height: float = 0.25, separation: float = 15.0) -> DataFrame:
    """(keys, n, bimodal, first, second, separation, height, dip): the two highest modes of each key, and whether they are two.

    ``separation``: degrees between them; ``height``: the second's over the first's; ``dip``:
    how far the density falls between them on the shorter way, as a share of the second. All three have to be above
    their bounds. Keys with fewer than ``least`` angles or a single mode have nulls and
    are not bimodal. Of equal peaks the later cell comes first.
    """

    def peaks(n: np.ndarray, density: np.ndarray) -> list[pa.Array]:
        both, *found = two_peaks(density, n >= least)
        return [pa.array(x, t, mask=~both) for x, t in zip(found, [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64()], strict=True)]

    rows = _of_counts(df, keys, angle, kappa, cells, peaks, "_i int, _j int, _hi double, _lo double, _w int, _least double")
    degrees = lambda c: F.col(c) * (360.0 / cells) - 180.0
    found = rows.select(*keys, "n", degrees("_i").alias("first"), degrees("_j").alias("second"), (F.least(F.col("_w"), cells - F.col("_w")) * (360.0 / cells)).alias("separation"), (F.col("_lo") / F.col("_hi")).alias("height"), (1 - F.col("_least") / F.col("_lo")).alias("dip"))
    two_of_them = (F.col("dip") > dip) & (F.col("height") > height) & (F.col("separation") > separation)
    return found.select(*keys, "n", F.coalesce(two_of_them, F.lit(False)).alias("bimodal"), "first", "second", "separation", "height", "dip")
