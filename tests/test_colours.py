"""Colour spaces, shadow in colour frames, clearer pictures, and the camera's direction."""

from __future__ import annotations

import colorsys
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyplume.functions import colour as K
from skyplume.functions.camera import Camera
from skyplume.operators import colours, orientation
from skyplume.operators.rasters import Grid


def test_spaces_against_the_standard_library(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, x)) for x in rng.integers(0, 256, (300, 3))] + [(0.0, 0.0, 0.0), (255.0, 255.0, 255.0), (255.0, 0.0, 0.0), (7.0, 7.0, 7.0), (10.0, 0.0, 10.0)]
    rgb = tuple(F.col(c) for c in "rgb")
    hue, s, v = K.hsv(*rgb)
    back = K.from_hsv(hue, s, v)
    out = spark.createDataFrame(rows, "r double, g double, b double").select(*"rgb", hue.alias("h"), s.alias("s"), v.alias("v"), K.lightness(*rgb).alias("l"), K.red_difference(*rgb).alias("cr"), *[x.alias(f"{n}2") for x, n in zip(back, "rgb", strict=True)], K.saturated(rgb, 0.0)[1].alias("grey"), K.balanced(rgb, (1.0, 2.0, 1.0))[1].alias("twice")).collect()
    for x in out:
        h, s, v = colorsys.rgb_to_hsv(x.r / 255, x.g / 255, x.b / 255)
        assert (x.h, x.s, x.v) == pytest.approx((180 * h, 255 * s, 255 * v), abs=1e-9)
        assert (x.r2, x.g2, x.b2) == pytest.approx((x.r, x.g, x.b), abs=1e-9)
        assert x.grey == pytest.approx(max(x.r, x.g, x.b)) and x.twice == min(2 * x.g, 255)
        y = sum(w * (c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4) for w, c in zip(K.LUMINANCE, (x.r, x.g, x.b), strict=True))
        assert x.l == pytest.approx(2.55 * (116 * y ** (1 / 3) - 16 if y > 0.008856 else 903.3 * y), abs=1e-9)
    white = next(x for x in out if (x.r, x.g, x.b) == (255, 255, 255))
    assert white.l == pytest.approx(255, abs=1e-3) and white.cr == pytest.approx(128)


def colour_frames(spark, arrays):
    rows = [(f, v, u, *map(float, a[v, u])) for f, a in arrays.items() for v in range(a.shape[0]) for u in range(a.shape[1])]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["frame", "v", "u", "r", "g", "b"]))


def test_a_planted_shadow_is_found(spark):
    """A dark and bluish patch of a brown ground that keeps its colour and its texture; a speck of it and bright ground are none."""
    rng = np.random.default_rng(2)
    rough = rng.normal(0, 2, (60, 80, 1))
    ground = np.array([150, 110, 60]) + rough
    shadow = np.array([28, 38, 62]) + 0.3 * rough
    dark = ground.copy()
    dark[20:45, 30:65], dark[5:8, 5:8] = shadow[20:45, 30:65], shadow[5:8, 5:8]
    back = colour_frames(spark, {0: ground}).drop("frame")
    scores = colours.shadow_scores(colour_frames(spark, {1: dark, 2: ground}), back, 60, 80).persist()
    score = {(r.frame, r.v, r.u): r.score for r in scores.collect()}
    assert len(score) == 2 * 60 * 80 and all(0 <= x <= 1 for x in score.values())
    assert score[1, 32, 48] > 0.8 and score[2, 32, 48] < 0.5
    got = {(r.frame, r.v, r.u) for r in colours.shadow_masks(scores, 60, 80, area=200).collect()}
    want = {(1, v, u) for v in range(20, 45) for u in range(30, 65)}
    assert {f for f, _, _ in got} == {1} and len(got & want) / len(got | want) > 0.9


def brute_morph(on, reach):
    steps = {(dv, du) for dv in range(-reach, reach + 1) for du in range(-round(math.sqrt(reach * reach - dv * dv)), round(math.sqrt(reach * reach - dv * dv)) + 1)}
    h, w = on.shape
    inside = lambda v, u: 0 <= v < h and 0 <= u < w
    grow = lambda a: np.array([[any(inside(v + d, u + e) and a[v + d, u + e] for d, e in steps) for u in range(w)] for v in range(h)])
    shrink = lambda a: np.array([[all(not inside(v + d, u + e) or a[v + d, u + e] for d, e in steps) for u in range(w)] for v in range(h)])
    return grow(shrink(on)), shrink(grow(on))


@pytest.mark.parametrize("reach", [1, 2, 3])
def test_opening_and_closing(reach):
    rng = np.random.default_rng(reach)
    for share in (0.2, 0.6, 0.9, 0.0, 1.0):
        on = rng.random((17, 14)) < share
        opened, closed = brute_morph(on, reach)
        assert (colours.opened(on, reach) == opened).all() and (colours.closed(on, reach) == closed).all()


def test_equalised_levels():
    rng = np.random.default_rng(3)
    a = np.clip(np.rint(rng.normal(120, 6, (64, 96))), 0, 255)
    out = colours.equalised(a, 4.0, 4)
    assert out.shape == a.shape and out.min() >= 0 and out.max() <= 255
    assert 1.5 * a.std() < out.std()  # contrast grows
    low = colours.equalised(a, 1.0, 4)
    assert low.std() < out.std()  # and less so where it is limited
    # Within a tile's middle the order of levels is kept.
    mid = colours.equalised(np.tile(np.arange(0, 256, 2), (128, 1)), 2.0, 1)
    assert (np.diff(mid[64]) >= 0).all()
    assert colours.equalised(np.full((30, 31), 9.0), 2.0, 8).std() < 1e-9


def test_clearer_pictures(spark):
    rng = np.random.default_rng(4)
    a = np.clip(np.array([120, 100, 90]) + rng.normal(0, 8, (40, 48, 1)) + rng.normal(0, 3, (40, 48, 3)), 0, 255)
    px = colour_frames(spark, {5: a})

    def array(rows):
        out = np.zeros((40, 48, 3))
        for r in rows.collect():
            out[r.v, r.u] = (r.r, r.g, r.b)
        return out

    same = array(colours.clearer(px, 40, 48, 0.0, 8, 1.0, 1.0, 1.0, 0.0, 0.0))
    np.testing.assert_allclose(same, a, atol=1e-9)
    np.testing.assert_allclose(array(colours.clearer(px, 40, 48, 0.0, 8, 2.0, 1.0, 0.5, 10.0, 0.0)), np.clip(0.5 * 255 * (a / 255) ** 0.5 + 10, 0, 255), atol=1e-9)
    sharp = array(colours.clearer(px, 40, 48, 0.0, 8, 1.0, 1.0, 1.0, 0.0, 0.7))
    np.testing.assert_allclose(sharp, np.stack([np.clip(1.7 * a[:, :, k] - 0.7 * orientation.blurred(a[:, :, k], 3.0), 0, 255) for k in range(3)], axis=2), atol=1e-9)
    assert array(colours.clearer(px, 40, 48))[:, :, 0].std() > 1.5 * a[:, :, 0].std()


def test_correlation_of_windows():
    rng = np.random.default_rng(5)
    picture, template = rng.normal(size=(30, 26)), rng.normal(size=(11, 9))
    windows = [(picture[i : i + 11, j : j + 9], template) for i in range(20) for j in range(18)]
    want = max(np.corrcoef(w.ravel(), t.ravel())[0, 1] for w, t in windows)
    assert orientation.best_correlation(picture, template) == pytest.approx(want)
    assert orientation.best_correlation(picture, picture[7:18, 4:13] * 3 + 50) == pytest.approx(1)
    assert orientation.best_correlation(np.ones((9, 9)), template[:5, :5]) == pytest.approx(0, abs=1e-6)


def test_a_planted_yaw_is_found(spark):
    """Between two angles of the sweep: the parabola comes within half a degree, and the picture's brightness and noise don't matter."""
    rng = np.random.default_rng(6)
    coarse = rng.normal(size=(40, 40))
    chart = spark.createDataFrame([(i, j, float(100 + 30 * coarse[j // 5, i // 5])) for i in range(200) for j in range(200)], "ix int, iy int, value double")
    land = spark.range(441).select((F.col("id") % 21).cast("int").alias("ix"), F.floor(F.col("id") / 21).cast("int").alias("iy"), (F.col("id") % 7).cast("double").alias("z"))
    camera = Camera.at(90.0, (400.0, 400.0, 90.0), 0.0, -30.0, 128, 96)
    seen = lambda yaws: orientation.seen_map(camera, yaws, -30.0, 2, chart, Grid(2.0, 2.0, 4.0, 200, 200), land, Grid(0.0, 0.0, 40.0, 21, 21), 4.0, 600.0)
    truth = seen([73.0]).drop("yaw").withColumn("value", F.col("value") * 0.5 + 40 + F.pmod(F.xxhash64("v", "u"), F.lit(5)))
    scores = orientation.yaw_scores(seen([62.0 + 2.5 * k for k in range(9)]), truth, 48, 64, 6, 1.0, 6.0)
    found = orientation.best_yaw(scores).first()
    assert found.yaw in (72.0, 74.5) and found.refined == pytest.approx(73.0, abs=0.6) and found.correlation > 0.6
    ends = spark.createDataFrame([(1.0, 0.9), (2.0, 0.5), (3.0, 0.5)], "yaw double, correlation double")
    assert tuple(orientation.best_yaw(ends).first()) == (1.0, 0.9, 1.0) and orientation.best_yaw(ends.filter("yaw > 9")).count() == 0
    flat = spark.createDataFrame([(0.0, 0.2), (1.0, 0.8), (2.0, 0.6)], "yaw double, correlation double")
    assert orientation.best_yaw(flat).first().refined == pytest.approx(1.25)
