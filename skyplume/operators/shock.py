"""A scale from the shock front: pulses of brightness, the ring they form in each frame, and the line of its growth.

Pixels are (frame, v, u, value) of one clip. A pixel's series is short and is
filtered whole; pixels are dealt out in blocks, each an array of (time, pixel).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions.guards import finite
from skyplume.operators.frames import filtered, passed_high
from skyplume.operators.quantiles import quantiles


def noise_floors(quiet: DataFrame, width: int, factor: float = 2.5, chunks: int = 8, cap: float = 0.5) -> DataFrame:
    """(v, u, floor): ``factor`` times each pixel's spread over quiet frames, held to the ``cap`` quantile of its strip of columns."""
    strip = F.floor(F.col("u") * chunks / width)
    own = quiet.groupBy("v", "u").agg((F.stddev_pop(finite(F.col("value"))) * factor).alias("floor")).withColumn("_s", strip.cast("int"))
    most = quantiles(own, ["_s"], F.col("floor"), [cap], ["_cap"])  # a row a strip
    return own.join(F.broadcast(most), "_s").select("v", "u", F.least("floor", "_cap").alias("floor"))


def pulses(px: DataFrame, floors: DataFrame, cutoff: float, rows: int = 500_000) -> DataFrame:
    """(frame, v, u, strength): moments at which a pixel's fast change is above those of the two frames on either side, and above its floor.

    ``cutoff`` is a share of half the frame rate. Frames that a pixel lacks count 0
    there; the first and last two frames of the clip have none.
    """
    clip = [r["frame"] for r in px.select("frame").distinct().orderBy("frame").collect()]  # one clip's frames
    n, first = len(clip), np.array(clip)
    if n < 5:
        return px.select("frame", "v", "u", F.col("value").cast("double").alias("strength")).filter(F.lit(False))

    def run(table: pa.Table) -> pa.Table:
        v, u = (table.column(c).to_numpy() for c in "vu")
        places, which = np.unique(v.astype(np.int64) << 32 | u, return_inverse=True)
        x = np.zeros((n, len(places)))
        x[np.searchsorted(first, table.column("frame").to_numpy()), which] = np.nan_to_num(table.column("value").to_numpy(zero_copy_only=False))
        floor = np.zeros(len(places))
        floor[which] = table.column("floor").to_numpy(zero_copy_only=False)
        fast = np.abs(passed_high(x, cutoff))
        core = fast[2:-2]
        high = (core > fast[1:-3]) & (core > fast[3:-1]) & (core > fast[:-4]) & (core > fast[4:]) & (core > floor)
        t, p = np.nonzero(high)
        return pa.table({"frame": pa.array(first[t + 2], pa.int64()), "v": pa.array(places[p] >> 32, pa.int32()), "u": pa.array(places[p] & 0xFFFFFFFF, pa.int32()), "strength": core[t, p]})

    known = px.select(F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("int").alias(c) for c in "vu"], F.col("value").cast("double").alias("value"))
    known = known.join(floors.select("v", "u", F.col("floor").cast("double").alias("floor")), ["v", "u"])
    blocks = known.count() // rows + 1
    return known.withColumn("_block", F.pmod(F.xxhash64("v", "u"), F.lit(blocks))).groupBy("_block").applyInArrow(run, "frame long, v int, u int, strength double")


def widened(found: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, v, u, strength): each pixel's strongest pulse within a box of one pixel."""

    def strongest(a: np.ndarray) -> np.ndarray:
        a = np.pad(np.nan_to_num(a), 1)
        out = np.max([a[i : i + height, j : j + width] for i in range(3) for j in range(3)], axis=0)
        return np.where(out > 0, out, np.nan)

    return filtered(found.withColumnRenamed("strength", "value"), height, width, strongest, "strength")


def chronic(found: DataFrame, before: list[int], threshold: float = 2.0, share: float = 0.35) -> DataFrame:
    """(v, u) of pixels with a pulse above ``threshold`` in more than ``share`` of the frames ``before`` the blast."""
    seen = found.filter(F.col("frame").isin(before) & (F.col("strength") > threshold))
    return seen.groupBy("v", "u").agg(F.countDistinct("frame").alias("_n")).filter(F.col("_n") > share * len(before)).select("v", "u")


def ring_sizes(spark: SparkSession, centre: tuple[float, float], height: int, width: int, rings: int = 400) -> DataFrame:
    """(ring, pixels): pixels of the frame at each distance from ``centre`` (u, v)."""
    at = spark.range(height * width).select(F.floor(F.col("id") / width).alias("v"), (F.col("id") % width).alias("u"))
    return at.groupBy(ring_of(centre, height, width, rings).alias("ring")).agg(F.count("*").alias("pixels"))


def farthest(centre: tuple[float, float], height: int, width: int) -> float:
    return math.hypot(max(centre[0], width - centre[0]), max(centre[1], height - centre[1]))


def ring_of(centre: tuple[float, float], height: int, width: int, rings: int):
    return F.least(F.floor(F.hypot(F.col("u") - centre[0], F.col("v") - centre[1]) * (rings / farthest(centre, height, width))), F.lit(rings - 1)).cast("int")


def fronts(found: DataFrame, centre: tuple[float, float], height: int, width: int, threshold: float = 2.0, rings: int = 400, bright: float = 4.0, least: int = 12, apart: DataFrame | None = None) -> DataFrame:
    """(frame, radius, n): the ring around ``centre`` (u, v) with the largest share of its pixels above ``threshold``, and the mean distance of those in it and next to it.

    A ring counts with ``least`` pixels whose share is ``bright`` times the frame's. Pixels of
    ``apart`` (v, u) don't count. Frames without such a ring are left out.
    """
    rows = found.filter(F.col("strength") > threshold)
    if apart is not None:
        rows = rows.join(apart.select("v", "u"), ["v", "u"], "left_anti")
    rows = rows.select("frame", F.hypot(F.col("u") - centre[0], F.col("v") - centre[1]).alias("_r"), ring_of(centre, height, width, rings).alias("ring"))
    per = rows.groupBy("frame", "ring").agg(F.count("*").alias("n"), F.sum("_r").alias("_sum"))
    total = per.groupBy("frame").agg((F.sum("n") / (height * width)).alias("_share"))
    sized = per.join(F.broadcast(ring_sizes(found.sparkSession, centre, height, width, rings)), "ring").join(total, "frame")  # ``rings`` rows
    share = F.col("n") / F.col("pixels")
    best = sized.filter((F.col("n") >= least) & (share >= bright * F.greatest("_share", F.lit(1e-6)))).groupBy("frame").agg(F.max_by("ring", F.struct(share, F.col("ring"))).alias("_best"))
    near = per.join(best, "frame").filter(F.abs(F.col("ring") - F.col("_best")) <= 1)
    return near.groupBy("frame").agg((F.sum("_sum") / F.sum("n")).alias("radius"), F.sum("n").alias("n"))


def front_line(points: DataFrame, keys: list[str], reference: str, fps: float, sound: float) -> DataFrame:
    """(keys, n, slope, intercept, r2, zero_frame, pixels_per_metre): the growth of ``radius`` of ``points`` (keys, frame, radius) over the frames since ``reference``, with a free intercept.

    The zero is the moment, between frames, at which the line has no radius; the
    scale follows from the speed of sound in metres a second. Keys with fewer than three
    points, or whose radius does not grow, are left out.
    """
    rows = points.select(*keys, F.col(reference).cast("double").alias("_ref"), (F.col("frame") - F.col(reference)).cast("double").alias("_dt"), finite(F.col("radius").cast("double")).alias("_r")).dropna(subset=["_dt", "_r"])
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_r", "_dt").alias("slope"), F.regr_intercept("_r", "_dt").alias("intercept"), F.regr_r2("_r", "_dt").alias("r2"), F.max("_ref").alias("_ref"))
    fit = fit.filter((F.col("n") >= 3) & (F.col("slope") > 0))
    return fit.select(*keys, "n", "slope", "intercept", "r2", (F.col("_ref") - F.col("intercept") / F.col("slope")).alias("zero_frame"), (F.col("slope") * fps / sound).alias("pixels_per_metre"))


def clicked(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frame, radius, reference) of marked points (keys, frame, place, x, y): distances from the first point of the first frame, which is the centre; that frame's own points don't count."""
    first = points.groupBy(*keys).agg(F.min_by(F.struct("frame", "x", "y"), F.struct("frame", "place")).alias("_c"))
    rows = points.join(first, keys).filter(F.col("frame") != F.col("_c.frame"))
    return rows.select(*keys, "frame", F.hypot(F.col("x") - F.col("_c.x"), F.col("y") - F.col("_c.y")).alias("radius"), F.col("_c.frame").alias("reference"))
