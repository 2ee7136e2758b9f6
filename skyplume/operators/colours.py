"""Colour frames: what speaks for shadow in them, masks of shadow, and pictures made clearer.

Pixels are (frame, v, u, r, g, b), channels 0 to 255. Grey arrays are a frame at a
time, as in ``frames``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyplume.functions import colour as K
from skyplume.operators import frames, images
from skyplume.operators.masks import AROUND, component_labels, ellipse
from skyplume.operators.orientation import blurred

RGB = ("r", "g", "b")


def shadow_scores(px: DataFrame, background: DataFrame, height: int, width: int, weights: dict = images.SHADOW) -> DataFrame:
    """(frame, v, u, score, dark, saturation, red, edges): how much speaks for shadow at each pixel, 0 to 1, and the measures it is made of.

    Darkness is the lightness; the loss of saturation and of edges is against the
    ``background`` (v, u, r, g, b); edges are Sobel gradients of the luma.
    """
    rgb = tuple(F.col(c) for c in RGB)
    grey = lambda rows: rows.select("frame", "v", "u", K.luma(*rgb).alias("value"))
    edge = images.edges(grey(px), height, width).select("frame", "v", "u", F.col("value").alias("_e"))
    edge_back = images.edges(grey(background.withColumn("frame", F.lit(0))), height, width).select("v", "u", F.col("value").alias("_eb"))
    back = background.select("v", "u", K.hsv(*rgb)[1].alias("_sb")).join(edge_back, ["v", "u"])
    rows = px.select("frame", "v", "u", K.lightness(*rgb).alias("dark"), K.hsv(*rgb)[1].alias("_s"), K.red_difference(*rgb).alias("red"))
    rows = rows.join(edge, ["frame", "v", "u"]).join(back, ["v", "u"])
    rows = rows.select("frame", "v", "u", "dark", (F.col("_sb") - F.col("_s")).alias("saturation"), "red", F.sqrt(F.greatest(F.col("_eb") - F.col("_e"), F.lit(0.0))).alias("edges"))
    return rows.withColumn("score", images.shadow_score({k: F.col(k) for k in weights}, weights)).select("frame", "v", "u", "score", "dark", "saturation", "red", "edges")


def moved(on: np.ndarray, steps: list[tuple[int, int]], reach: int, all_of_them: bool) -> np.ndarray:
    """Whether any, or all, of the places ``steps`` away are on; places beyond the border don't count."""
    wide = np.pad(on, reach, constant_values=all_of_them)
    out = np.full(on.shape, all_of_them)
    for dv, du in steps:
        part = wide[reach + dv : reach + dv + on.shape[0], reach + du : reach + du + on.shape[1]]
        out = out & part if all_of_them else out | part
    return out


def opened(on: np.ndarray, reach: int) -> np.ndarray:
    """Without what an ellipse of ``reach`` does not fit into."""
    steps = ellipse(reach)
    return moved(moved(on, steps, reach, True), steps, reach, False)


def closed(on: np.ndarray, reach: int) -> np.ndarray:
    """With the gaps that an ellipse of ``reach`` does not fit into."""
    steps = ellipse(reach)
    return moved(moved(on, steps, reach, False), steps, reach, True)


def shadow_masks(scores: DataFrame, height: int, width: int, least: float = 0.55, area: int = 800, reach: int = 3) -> DataFrame:
    """(frame, v, u) of the pixels of ``scores`` (frame, v, u, score) at ``least`` or above, opened and closed by an ellipse, in 8-neighbour components of ``area`` pixels or more."""

    def clean(score: np.ndarray) -> np.ndarray:
        on = closed(opened(np.nan_to_num(score) >= least, reach), reach)
        cells = np.argwhere(on)
        if not len(cells):
            return np.full(on.shape, np.nan)
        label, count = np.unique(component_labels(cells, AROUND), return_inverse=True, return_counts=True)[1:]
        cells = cells[count[label] >= area]
        out = np.full(on.shape, np.nan)
        out[cells[:, 0], cells[:, 1]] = 1.0
        return out

    return frames.filtered(scores.withColumnRenamed("score", "value"), height, width, clean, "on").select("frame", "v", "u")


def equalised(a: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Contrast-limited adaptive equalisation of whole levels 0 to 255: each tile's histogram is held to ``clip`` times an even one, what is cut off is dealt to all levels, and levels are mixed between the tiles' centres."""
    height, width = a.shape
    high, wide = -(-height // tiles), -(-width // tiles)
    padded = np.pad(a, ((0, high * tiles - height), (0, wide * tiles - width)), mode="reflect").astype(np.int64)
    blocks = padded.reshape(tiles, high, tiles, wide).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    n = high * wide
    hist = np.stack([np.bincount(b, minlength=256) for b in blocks]).astype(float)
    most = max(1.0, clip * n / 256)
    over = np.maximum(hist - most, 0).sum(axis=1, keepdims=True)
    table = np.minimum(np.cumsum(np.minimum(hist, most) + over / 256, axis=1) * (255 / n), 255).reshape(tiles, tiles, 256)

    def between(size: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(size) + 0.5) / tile - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (i0, i1, p), (j0, j1, q) = between(height, high), between(width, wide)
    level = a.astype(np.int64)
    look = lambda i, j: table[i[:, None], j[None, :], level]
    p, q = p[:, None], q[None, :]
    return (look(i0, j0) * (1 - q) + look(i0, j1) * q) * (1 - p) + (look(i1, j0) * (1 - q) + look(i1, j1) * q) * p


def sharpened(a: np.ndarray, amount: float, sigma: float = 3.0) -> np.ndarray:
    """Unsharp mask."""
    return np.clip(a * (1 + amount) - amount * blurred(a, sigma), 0, 255)


def clearer(px: DataFrame, height: int, width: int, clip: float = 2.0, tiles: int = 8, gamma: float = 1.2, saturation: float = 1.3, contrast: float = 1.0, brightness: float = 0.0, unsharp: float = 0.3) -> DataFrame:
    """(frame, v, u, r, g, b): lightness equalised (0: not), then gamma, saturation, contrast and brightness, and an unsharp mask (0: not).

    The equalised lightness scales the channels alike. A frame has to have all its
    pixels; levels come out between 0 and 255, unrounded.
    """
    rows = px.select("frame", *[F.col(c).cast("int").alias(c) for c in "vu"], *[F.col(c).cast("double").alias(c) for c in RGB], K.lightness(*[F.col(c) for c in RGB]).alias("_l"))

    def light(table: pa.Table) -> pa.Table:
        a = {c: frames.array_of(table, height, width, c) for c in (*RGB, "_l")}
        low = np.clip(np.rint(np.nan_to_num(a["_l"])), 0, 255)
        gain = np.maximum(equalised(low, clip, tiles), 0.0) / np.maximum(low, 1.0)
        return arrays(table, [np.clip(a[c] * gain, 0, 255) for c in RGB])

    def sharp(table: pa.Table) -> pa.Table:
        return arrays(table, [sharpened(frames.array_of(table, height, width, c), unsharp) for c in RGB])

    def arrays(table: pa.Table, channels: list[np.ndarray]) -> pa.Table:
        v, u = np.indices((height, width)).reshape(2, -1)
        frame = table.column("frame").combine_chunks().take(pa.array(np.zeros(len(v), np.int64)))
        return pa.table({"frame": frame, "v": pa.array(v, pa.int32()), "u": pa.array(u, pa.int32()), **{c: x.ravel() for c, x in zip(RGB, channels, strict=True)}})

    kinds = f"frame {px.schema['frame'].dataType.simpleString()}, v int, u int, r double, g double, b double"
    if clip > 0:
        rows = rows.groupBy("frame").applyInArrow(light, kinds)
    rgb = tuple(255 * F.pow(F.col(c) / 255, F.lit(1 / gamma)) for c in RGB)
    if saturation != 1:
        rgb = K.saturated(rgb, saturation)
    rows = rows.select("frame", "v", "u", *[K.held(contrast * x + brightness).alias(c) for x, c in zip(rgb, RGB, strict=True)])
    return rows.groupBy("frame").applyInArrow(sharp, kinds) if unsharp > 0 else rows
