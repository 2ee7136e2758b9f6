"""Frames as arrays: filters, metrics and registration, a frame at a time.

A frame is bounded by its size, so a task holds one as an array and a filter
costs one pass over it; pixels are shuffled once, by frame, and not copied to
their neighbours. Pixels that a table lacks, or whose value is null or NaN, are
missing: they count for nothing, and a place whose whole neighbourhood is missing
comes out of no filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a frame that are filtered together.
STRIP = 64


def array_of(table: pa.Table, height: int, width: int, value: str = "value") -> np.ndarray:
    """Pixels (v, u, value) as (height, width), NaN where there is none; of repeated ones any."""
    out = np.full((height, width), np.nan)
    v, u, x = table.column("v").to_numpy(), table.column("u").to_numpy(), table.column(value).to_numpy()
    inside = (v >= 0) & (v < height) & (u >= 0) & (u < width)
    out[v[inside], u[inside]] = x[inside]
    return out


def filtered(px: DataFrame, height: int, width: int, f: Callable[[np.ndarray], np.ndarray], name: str = "value") -> DataFrame:
    """(frame, v, u, name): ``f`` of each frame's array, where it is a number."""

    def run(table: pa.Table) -> pa.Table:
        out = f(array_of(table, height, width))
        v, u = np.nonzero(np.isfinite(out))
        frame = table.column("frame").combine_chunks().take(pa.array(np.zeros(len(v), np.int64)))
        return pa.table({"frame": frame, "v": pa.array(v, pa.int32()), "u": pa.array(u, pa.int32()), name: out[v, u]})

    rows = px.select("frame", F.col("v").cast("int").alias("v"), F.col("u").cast("int").alias("u"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("frame").applyInArrow(run, f"frame {px.schema['frame'].dataType.simpleString()}, v int, u int, {name} double")


def boxes(a: np.ndarray, reach: int):
    """(first row, view): each pixel's box of neighbours, some rows at a time; beyond the border its pixel is repeated."""
    wide = np.pad(a, reach, mode="edge")
    for lo in range(0, len(a), STRIP):
        part = wide[lo : lo + STRIP + 2 * reach]
        yield lo, np.lib.stride_tricks.sliding_window_view(part, (2 * reach + 1, 2 * reach + 1))


def median_box(a: np.ndarray, reach: int) -> np.ndarray:
    out = np.full(a.shape, np.nan)
    for lo, view in boxes(a, reach):
        flat = np.sort(view.reshape(*view.shape[:2], -1), axis=2)  # NaN last
        n = np.isfinite(flat).sum(axis=2)
        at = lambda k, flat=flat: np.take_along_axis(flat, np.maximum(k, 0)[:, :, None], axis=2)[:, :, 0]
        out[lo : lo + len(view)] = np.where(n > 0, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)
    return out


def correlated(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sum of a pixel's neighbours times ``kernel``; those missing count 0."""
    reach = len(kernel) // 2
    wide, held = np.pad(np.nan_to_num(a), reach, mode="edge"), np.pad(np.isfinite(a), reach, mode="edge")
    out, any_ = np.zeros(a.shape), np.zeros(a.shape, bool)
    for i in range(len(kernel)):
        for j in range(len(kernel)):
            part = np.s_[i : i + a.shape[0], j : j + a.shape[1]]
            out += kernel[i, j] * wide[part]
            any_ |= held[part]
    return np.where(any_, out, np.nan)


#: Derivatives across and down.
SOBEL_U = np.array([[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]])
SOBEL_V = SOBEL_U.T


def gaussian_kernel(sigma: float, reach: int) -> np.ndarray:
    x = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return x / x.sum()


def smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur along both axes; NaN where it would draw on what is missing or beyond the border."""
    reach = max(1, math.ceil(3 * sigma))
    k = gaussian_kernel(sigma, reach)
    for axis in (0, 1):
        wide = np.pad(a, [(reach, reach) if i == axis else (0, 0) for i in (0, 1)], constant_values=np.nan)
        a = sum(w * np.take(wide, np.arange(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(k))
    return a


# Time


def passed_high(x: np.ndarray, cutoff: float) -> np.ndarray:
    """Fast changes of series (time, ...): a second-order Butterworth high-pass forward and back, ends extended by odd reflection; ``cutoff`` as a share of half the sampling rate."""
    k = math.tan(math.pi * cutoff / 2)
    norm = 1 / (1 + math.sqrt(2) * k + k * k)
    b0, a1, a2 = norm, 2 * (k * k - 1) * norm, (1 - math.sqrt(2) * k + k * k) * norm

    def once(x: np.ndarray) -> np.ndarray:
        # The state a constant input leaves behind, so that the first sample makes no step.
        z1, z2 = -b0 * x[0], b0 * x[0]
        out = np.empty_like(x)
        for i, v in enumerate(x):
            out[i] = b0 * v + z1
            z1 = -2 * b0 * v - a1 * out[i] + z2
            z2 = b0 * v - a2 * out[i]
        return out

    pad = min(9, len(x) - 1)
    if pad:
        x = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    y = once(once(x)[::-1])[::-1]
    return y[pad : len(y) - pad]


# Metrics of masks


def spread_out(on: np.ndarray, reach: int) -> np.ndarray:
    """Pixels within a box of ``reach`` of one that is on: running sums along both axes."""
    for axis in (0, 1):
        n = on.shape[axis]
        total = np.concatenate((np.zeros_like(np.take(on, [0], axis), int), np.cumsum(on, axis=axis)), axis=axis)
        at = np.arange(n)
        on = np.take(total, np.minimum(at + reach + 1, n), axis) > np.take(total, np.maximum(at - reach, 0), axis)
    return on


METRICS = "area long, texture double, texture_in double, texture_ring double, contrast double, std_in double, edge_distance double, edge_share double, cut double"


def mask_metrics(px: DataFrame, mask: DataFrame, height: int, width: int, ring: int = 15) -> DataFrame:
    """(frame, ...): texture, contrast and distance to the border of each frame's mask (frame, v, u) over its grey levels (frame, v, u, value).

    The ring is what lies within ``ring`` of the mask and not in it. ``texture``: share
    of the mask whose gradient is above the ring's median one; texture_in and
    texture_ring: mean gradients; ``contrast``: difference of the mean levels over the
    root of their mean variance; null without a ring. edge_distance: 5 % quantile of
    the distance to the nearest border, edge_share: the mask's share nearer than 4 %
    of the shorter side, ``cut``: on the border. Frames without a mask or without
    levels are left out; levels that are missing count 0.
    """

    def run(table: pa.Table) -> pa.Table:
        on = array_of(table, height, width, "m") == 1
        grey = array_of(table, height, width)
        if not on.any() or not np.isfinite(grey).any():
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        grey = np.nan_to_num(grey)
        steep = np.hypot(correlated(grey, SOBEL_U), correlated(grey, SOBEL_V))
        around = spread_out(on, ring) & ~on
        inside, outside = grey[on], grey[around]
        row = [table.column("frame")[0].as_py(), int(on.sum()), None, float(steep[on].mean()), None, None, float(inside.std())]
        if len(outside):
            row[2], row[4] = float((steep[on] > np.median(steep[around])).mean()), float(steep[around].mean())
            row[5] = float(abs(inside.mean() - outside.mean()) / math.sqrt(0.5 * (inside.var() + outside.var()) + 1e-9))
        v, u = np.nonzero(on)
        far = np.minimum(np.minimum(u, width - 1 - u), np.minimum(v, height - 1 - v)).astype(float)
        row += [float(np.percentile(far, 5)), float((far < 0.04 * min(height, width)).mean()), float((far < 1).mean())]
        return pa.table({n: pa.array([x], t) for n, x, t in zip(names, row, kinds, strict=True)})

    names = ["frame", *(x.split()[0] for x in METRICS.split(", "))]
    kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 8]
    a = px.select(F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("int").alias(c) for c in "vu"], F.col("value").cast("double").alias("value"), F.lit(None).cast("double").alias("m"))
    b = mask.select(F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("int").alias(c) for c in "vu"], F.lit(None).cast("double").alias("value"), F.lit(1.0).alias("m"))
    both = a.union(b).groupBy("frame", "v", "u").agg(F.max("value").alias("value"), F.max("m").alias("m"))
    return both.groupBy("frame").applyInArrow(run, f"frame long, {METRICS}")


# Registration


def sampled(a: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Values between pixels, NaN beyond the frame."""
    height, width = a.shape
    ok = (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1)
    i, j = (np.clip(np.floor(np.where(ok, x, 0)).astype(int), 0, n - 2) for x, n in ((v, height), (u, width)))
    p, q = v - i, u - j
    out = (a[i, j] * (1 - q) + a[i, j + 1] * q) * (1 - p) + (a[i + 1, j] * (1 - q) + a[i + 1, j + 1] * q) * p
    return np.where(ok, out, np.nan)


def halved(a: np.ndarray) -> np.ndarray:
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    return a[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))


def climb(frame: np.ndarray, back: np.ndarray, p: np.ndarray, times: int, eps: float) -> tuple[np.ndarray, float, bool]:
    """Parameters (angle, move across, move down, about the middle) that raise the correlation of ``frame`` with the moved ``back`` from ``p`` on; the correlation, and whether it came to rest."""
    height, width = frame.shape
    v, u = (x.ravel() for x in np.indices(frame.shape).astype(float))
    cu, cv = (width - 1) / 2, (height - 1) / 2
    x, y = u - cu, v - cv
    gv, gu = np.gradient(back)
    last, known = -1.0, np.isfinite(frame.ravel())
    for _ in range(times):
        c, s = math.cos(p[0]), math.sin(p[0])
        at_u, at_v = c * x - s * y + cu + p[1], s * x + c * y + cv + p[2]
        image, du, dv = (sampled(a, at_u, at_v) for a in (back, gu, gv))
        ok = np.isfinite(image + du + dv) & known
        if ok.sum() < max(16, 0.25 * known.sum()):
            return p, last, False
        image, template, du, dv = image[ok] - image[ok].mean(), frame.ravel()[ok], du[ok], dv[ok]
        template = template - template.mean()
        size = math.sqrt((image @ image) * (template @ template))
        if size < 1e-12:
            return p, last, False
        now = float(image @ template) / size
        if abs(now - last) < eps:
            return p, now, True
        last = now
        steps = np.stack([du * (-s * x[ok] - c * y[ok]) + dv * (c * x[ok] - s * y[ok]), du, dv], axis=1)
        normal = steps.T @ steps
        if np.linalg.cond(normal) > 1e14:
            return p, last, False
        of_image, of_template = steps.T @ image, steps.T @ template
        solved = np.linalg.solve(normal, np.stack([of_image, of_template], axis=1))
        below = float(template @ image - of_template @ solved[:, 0])
        if below <= 0:
            return p, last, False
        scale = float(image @ image - of_image @ solved[:, 0]) / below
        p = p + scale * solved[:, 1] - solved[:, 0]
    return p, last, True


def aligned(frame: np.ndarray, back: np.ndarray, sigma: float = 1.0, times: int = 60, eps: float = 1e-7, least: int = 24) -> tuple[float, float, float, float, bool]:
    """(degrees, move across, move down, correlation, converged): where the background lies for each pixel (u, v) of the frame.

    The turn is about pixel (0, 0), as in: u cos - v sin + across. Both are blurred
    alike; what the blur draws from beyond them, and what is missing (NaN), does
    not count. Sizes are halved down to ``least`` pixels, and each size starts from what
    the coarser one found. Where it finds no rest, or nothing correlates, the
    answer is no move.
    """
    pairs = [(smoothed(frame, sigma), smoothed(back, sigma))]
    while min(pairs[-1][0].shape) >= 2 * least:
        pairs.append(tuple(halved(a) for a in pairs[-1]))
    p, found, ok = np.zeros(3), 0.0, False
    for k, (a, b) in enumerate(reversed(pairs)):
        p = p * (1, 2, 2) if k else p
        p, found, ok = climb(a, b, p, times, eps)
        if not ok:
            return 0.0, 0.0, 0.0, max(found, 0.0), False
    height, width = frame.shape
    cu, cv, c, s = (width - 1) / 2, (height - 1) / 2, math.cos(p[0]), math.sin(p[0])
    return math.degrees(p[0]), p[1] + cu - c * cu + s * cv, p[2] + cv - s * cu - c * cv, found, True


MOVE = "degrees double, across double, down double, correlation double, converged boolean"


def registered(px: DataFrame, background: DataFrame, height: int, width: int, **how) -> DataFrame:
    """(frame, degrees, across, down, correlation, converged) of ``aligned`` for each frame of ``px`` (frame, v, u, value) against ``background`` (v, u, value).

    The background is one frame, whose array goes along with each of the others; where
    it has a column ``frame``, each frame has its own, and frames without one are left out.
    """

    def pack(table: pa.Table) -> pa.Table:
        a = array_of(table, height, width)
        return pa.table({"frame": table.column("frame").slice(0, 1), "pixels": pa.array([a.tobytes()], pa.binary())})

    def packed(rows: DataFrame) -> DataFrame:
        kind = rows.schema["frame"].dataType.simpleString()
        return rows.select("frame", *[F.col(c).cast("int").alias(c) for c in "vu"], F.col("value").cast("double").alias("value")).groupBy("frame").applyInArrow(pack, f"frame {kind}, pixels binary")

    def run(batches):
        for b in batches:
            rows = [aligned(*(np.frombuffer(b.column(k)[i].as_py()).reshape(height, width) for k in (1, 2)), **how) for i in range(b.num_rows)]
            kinds = [*[pa.float64()] * 4, pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], ["frame", *(x.split()[0] for x in MOVE.split(", "))])

    if "frame" in background.columns:
        both = packed(px).join(packed(background).withColumnRenamed("pixels", "back"), "frame")
    else:
        back = packed(background.withColumn("frame", F.lit(0))).select(F.col("pixels").alias("back"))  # one row of a frame's size
        both = packed(px).join(F.broadcast(back))
    return both.select("frame", "pixels", "back").mapInArrow(run, f"frame {px.schema['frame'].dataType.simpleString()}, {MOVE}")
