"""Frames as grey levels: (frame, v, u, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyplume.functions.guards import finite
from skyplume.functions.physics import sigmoid
from skyplume.operators import frames
from skyplume.operators.quantiles import quantiles
from skyplume.sources.folder import settled

#: Pixels of a frame that is handed to all tasks.
HELD = 1_000_000


def held(frame: DataFrame) -> DataFrame:
    """One frame, computed once, for a join with many.

    It is broadcast up to ``HELD`` pixels and merged beyond. The planner is not left
    to choose: it takes exploded pixels for as small as what they come from, and would
    broadcast those.
    """
    rows = settled(frame)
    return F.broadcast(rows) if rows.count() <= HELD else rows.hint("merge")


def convolved(px: DataFrame, kernel: list[list[float]], height: int, width: int, name: str = "value") -> DataFrame:
    """Correlation with an odd square ``kernel``; beyond the border the border's pixel is repeated."""
    weights = np.array(kernel, float)
    return frames.filtered(px, height, width, lambda a: frames.correlated(a, weights), name)


def blurred_median(px: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """Median of each pixel's box."""
    return frames.filtered(px, height, width, lambda a: frames.median_box(a, reach))


def edges(px: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, v, u, value): squared length of the Sobel gradient."""
    return frames.filtered(px, height, width, lambda a: frames.correlated(a, frames.SOBEL_U) ** 2 + frames.correlated(a, frames.SOBEL_V) ** 2)


def photometric_fit(px: DataFrame, background: DataFrame, limits: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """(frame, gain, offset) that bring each frame's quartiles to the background's (v, u, value); a frame without contrast has 1 and 0."""
    q = quantiles(px, ["frame"], F.col("value"), [0.25, 0.75], ["a", "b"])
    bg = background.select(F.lit(0).alias("one"), "value")
    r = quantiles(bg, ["one"], F.col("value"), [0.25, 0.75], ["ra", "rb"]).drop("one")
    gain = F.when(F.col("b") - F.col("a") < 1e-3, 1.0).otherwise(F.least(F.greatest((F.col("rb") - F.col("ra")) / (F.col("b") - F.col("a")), F.lit(limits[0])), F.lit(limits[1])))
    offset = F.when(F.col("b") - F.col("a") < 1e-3, 0.0).otherwise(F.col("ra") - gain * F.col("a"))
    return q.join(F.broadcast(r)).select("frame", gain.alias("gain"), offset.alias("offset"))


def novelty(px: DataFrame, background: DataFrame, fit: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(frame, v, u, *keep, value): distance of the fitted grey level from the background's; ``keep``: columns of ``px`` that go along."""
    rows = px.join(fit.hint("shuffle_hash"), "frame").join(held(background.select("v", "u", F.col("value").alias("_b"))), ["v", "u"])
    return rows.select("frame", "v", "u", *keep, F.abs(F.col("gain") * F.col("value") + F.col("offset") - F.col("_b")).alias("value"))


def candidates(heat: Column, new: Column, least_heat: float, least_new: float) -> Column:
    """Where heat and novelty are both above their thresholds; false for null and NaN."""
    return F.coalesce((finite(heat) > least_heat) & (finite(new) > least_new), F.lit(False))


#: Weight, centre and slope of what speaks for shadow: darkness, saturation that is not lost, little red, edges that are not lost.
SHADOW = {"dark": (0.35, 80.0, -0.08), "saturation": (0.25, 30.0, -0.10), "red": (0.20, 120.0, -0.06), "edges": (0.20, 20.0, -0.12)}


def shadow_score(parts: dict[str, Column], weights: dict = SHADOW) -> Column:
    """Weighted sum of sigmoids, 0 to 1."""
    return sum((w * sigmoid(parts[k], centre, slope) for k, (w, centre, slope) in weights.items()), F.lit(0.0))


def matched(template: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, correlation): normalised correlation of each candidate image (keys, v, u, value) with the template (v, u, value) on the pixels that both have."""
    rows = images.join(held(template.select("v", "u", F.col("value").alias("_t"))), ["v", "u"])
    return rows.groupBy(*keys).agg(F.corr("value", "_t").alias("correlation"))


def shift(px: DataFrame, reference: DataFrame, reach: int) -> DataFrame:
    """(frame, dv, du): the whole-pixel move within ``reach`` that lines each frame up with the reference (v, u, value) best, by correlation; ties to the least move."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    moved = px.select("frame", "v", "u", "value", F.explode(step).alias("dv")).select("frame", "v", "u", "value", "dv", F.explode(step).alias("du"))
    moved = moved.select("frame", "dv", "du", (F.col("v") + F.col("dv")).alias("v"), (F.col("u") + F.col("du")).alias("u"), "value")
    fit = matched(reference, moved, ["frame", "dv", "du"])
    far = F.abs("dv") + F.abs("du")
    best = F.max(F.struct(F.round("correlation", 9).alias("c"), (-far).alias("f"), (-F.col("dv")).alias("v"), (-F.col("du")).alias("u"))).alias("_b")
    return fit.groupBy("frame").agg(best).select("frame", (-F.col("_b.v")).alias("dv"), (-F.col("_b.u")).alias("du"), F.col("_b.c").alias("correlation"))
