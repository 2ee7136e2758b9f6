"""Filters, metrics and registration of frames, density modes, and what sun and camera reach, against plain versions and known answers."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.operators import frames, images, light, masks, modes, series
from skyplume.operators.rasters import Grid


def pixels(spark, arrays):
    """(frame, v, u, value) of arrays by frame; NaN is left out."""
    rows = [(f, v, u, float(a[v, u])) for f, a in arrays.items() for v, u in zip(*np.nonzero(np.isfinite(a)), strict=True)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["frame", "v", "u", "value"]))


# Frames


def brute(a, reach, f):
    h, w = a.shape
    out = np.full(a.shape, np.nan)
    for v in range(h):
        for u in range(w):
            near = np.array([[a[min(max(v + i, 0), h - 1), min(max(u + j, 0), w - 1)] for j in range(-reach, reach + 1)] for i in range(-reach, reach + 1)])
            if np.isfinite(near).any():
                out[v, u] = f(near)
    return out


def test_filters(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(70, 9))
    a[rng.random(a.shape) < 0.2] = np.nan
    a[:8, :5] = np.nan
    kernel = rng.normal(size=(5, 5))
    px = pixels(spark, {4: a})
    for got, want in ((images.blurred_median(px, 2, 70, 9), brute(a, 2, np.nanmedian)), (images.convolved(px, kernel.tolist(), 70, 9), brute(a, 2, lambda x: np.nansum(x * kernel)))):
        out = np.full(a.shape, np.nan)
        for r in got.collect():
            out[r.v, r.u] = r.value
        np.testing.assert_allclose(out, want, atol=1e-9)
    edge = brute(a, 1, lambda x: np.nansum(x * frames.SOBEL_U) ** 2 + np.nansum(x * frames.SOBEL_V) ** 2)
    assert {(r.v, r.u): pytest.approx(r.value) for r in images.edges(px, 70, 9).collect()} == {(v, u): edge[v, u] for v, u in zip(*np.nonzero(np.isfinite(edge)), strict=True)}
    assert images.edges(px.filter("frame = 5"), 70, 9).count() == 0


def test_large_masks_pack_at_once(spark):
    """A frame of 1920 x 1080 with half its pixels on, packed and unpacked."""
    on = np.random.default_rng(2).random((1080, 1920)) < 0.5
    bits = np.packbits(on).tobytes()
    sets = spark.createDataFrame([(1, 1080, 1920, bits)], "frame long, h int, w int, bits binary")
    px = masks.unpacked(sets).persist()
    assert px.count() == on.sum()
    began = time.time()
    back = masks.packed(px, 1080, 1920).collect()
    assert time.time() - began < 20 and bytes(back[0].bits) == bits and len(bits) == 259_200
    px.unpersist()
    assert masks.packed(spark.createDataFrame([(1, 0, 9), (1, 5, 0), (1, -1, 0), (1, 0, 0)], "frame int, v int, u int"), 2, 9).first().bits == bytes([128, 0, 0])


def slow_high_pass(x, cutoff):
    k = math.tan(math.pi * cutoff / 2)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    a1, a2 = 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n
    pad = min(9, len(x) - 1)
    if pad:
        x = [*(2 * x[0] - x[i] for i in range(pad, 0, -1)), *x, *(2 * x[-1] - x[-1 - i] for i in range(1, pad + 1))]

    def once(x):
        # Direct form, started as if the first sample had always been there: then nothing passes.
        y, px, py = [], [x[0], x[0]], [0.0, 0.0]
        for v in x:
            out = n * (v - 2 * px[0] + px[1]) - a1 * py[0] - a2 * py[1]
            px, py = [v, px[0]], [out, py[0]]
            y.append(out)
        return y

    y = once(once(list(x))[::-1])[::-1]
    return y[pad : len(y) - pad] if pad else y


@pytest.mark.parametrize("rows", [40, 500_000])
def test_high_pass_is_the_plain_filter(spark, rows):
    rng = np.random.default_rng(3)
    data = [(f"p{k}", k % 2, i, float(rng.normal()) if i != 3 else None) for k in range(12) for i in range([1, 2, 7, 30][k % 4])]
    df = spark.createDataFrame(data, "px string, half int, frame int, value double").repartition(3)
    got = {(r.px, r.frame): r.passed for r in series.high_pass(df, ["px", "half"], ["frame"], "value", 0.2, rows).collect()}
    assert len(got) == len(data)
    for k in range(12):
        mine = [d for d in data if d[0] == f"p{k}"]
        for (_, _, i, _), want in zip(mine, slow_high_pass([d[3] or 0.0 for d in mine], 0.2), strict=True):
            assert got[f"p{k}", i] == pytest.approx(want, abs=1e-9)


def test_mask_metrics(spark):
    rng = np.random.default_rng(4)
    grey = {f: rng.normal(100, 20, (30, 40)) for f in range(4)}
    on = {0: np.zeros((30, 40), bool), 1: np.zeros((30, 40), bool), 2: np.ones((30, 40), bool), 3: np.zeros((30, 40), bool)}
    on[0][5:15, 8:20] = True
    on[1][0:3, 0:2] = True
    mask = spark.createDataFrame([(f, int(v), int(u)) for f, m in on.items() for v, u in zip(*np.nonzero(m), strict=True)] + [(9, 1, 1)], "frame long, v int, u int")
    got = {r.frame: r for r in frames.mask_metrics(pixels(spark, grey), mask, 30, 40, 4).collect()}
    assert set(got) == {0, 1, 2}  # frame 3 has no mask, frame 9 no levels
    for f, r in got.items():
        a, m = grey[f], on[f]
        gu, gv = (brute(a, 1, lambda x, k=k: (x * k).sum()) for k in (frames.SOBEL_U, frames.SOBEL_V))
        steep = np.hypot(gu, gv)
        ring = np.zeros_like(m)
        for v, u in zip(*np.nonzero(m), strict=True):
            ring[max(0, v - 4) : v + 5, max(0, u - 4) : u + 5] = True
        ring &= ~m
        v, u = np.nonzero(m)
        far = np.minimum(np.minimum(u, 39 - u), np.minimum(v, 29 - v))
        assert r.area == m.sum() and r.texture_in == pytest.approx(steep[m].mean()) and r.std_in == pytest.approx(a[m].std())
        assert (r.edge_distance, r.edge_share, r.cut) == pytest.approx((np.percentile(far, 5), (far < 1.2).mean(), (far < 1).mean()))
        if ring.any():
            assert r.texture == pytest.approx((steep[m] > np.median(steep[ring])).mean()) and r.texture_ring == pytest.approx(steep[ring].mean())
            assert r.contrast == pytest.approx(abs(a[m].mean() - a[ring].mean()) / math.sqrt(0.5 * (a[m].var() + a[ring].var())))
        else:
            assert (r.texture, r.texture_ring, r.contrast) == (None, None, None)


def picture(u, v):
    """A smooth picture that is known between pixels."""
    rng = np.random.default_rng(5)
    out = np.zeros_like(u)
    for _ in range(40):
        a, b, c, d = rng.normal(size=4)
        out += d * np.sin(0.11 * (a * u + b * v) + 6 * c)
    return 100 + 20 * out


MOVES = {1: (0.0, 0.0, 0.0), 2: (0.0, 3.4, -2.3), 3: (2.0, 1.5, 4.25), 4: (-3.5, -6.2, 5.1), 5: (0.4, -0.37, 0.61)}


def test_registration_finds_known_moves(spark):
    """Within 0.05 pixel and 0.05 degrees, also with half a frame's brightness and noise; identity where nothing correlates."""
    height, width = 96, 128
    v, u = (x.astype(float) for x in np.indices((height, width)))
    rng = np.random.default_rng(6)
    arrays = {}
    for f, (angle, across, down) in MOVES.items():
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        arrays[f] = 0.5 * picture(c * u - s * v + across, s * u + c * v + down) + 7 + rng.normal(0, 0.2, u.shape)
    arrays[2][:20, :30] = np.nan  # not all of a frame has to be there
    arrays[6], arrays[7] = rng.normal(size=u.shape) * 1e3, np.full(u.shape, 3.0)
    back = pixels(spark, {0: picture(u, v)}).drop("frame")
    got = {r.frame: r for r in frames.registered(pixels(spark, arrays), back, height, width).collect()}
    for f, (angle, across, down) in MOVES.items():
        assert got[f].converged and got[f].correlation > 0.99
        assert (got[f].degrees, got[f].across, got[f].down) == pytest.approx((angle, across, down), abs=0.05 if f < 3 else 0.08), f
        # What a move of the middle of the frame says of where it lies.
        c, s = math.cos(math.radians(got[f].degrees)), math.sin(math.radians(got[f].degrees))
        d, e = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        assert (c * 64 - s * 48 + got[f].across, s * 64 + c * 48 + got[f].down) == pytest.approx((d * 64 - e * 48 + across, e * 64 + d * 48 + down), abs=0.05)
    assert not got[7].converged and (got[7].degrees, got[7].across, got[7].down) == (0.0, 0.0, 0.0)
    assert got[6].correlation < 0.5


def test_ellipses(spark):
    assert sorted(masks.ellipse(0)) == [(0, 0)]
    drawn = lambda r: ["".join("#" if (dv, du) in set(masks.ellipse(r)) else "." for du in range(-r, r + 1)) for dv in range(-r, r + 1)]
    assert drawn(1) == [".#.", "###", ".#."]
    assert drawn(2) == ["..#..", "#####", "#####", "#####", "..#.."]
    assert drawn(3) == ["...#...", ".#####.", "#######", "#######", "#######", ".#####.", "...#..."]
    px = spark.createDataFrame([(1, 0, 0), (1, 4, 4), (2, 2, 2)], "frame int, v int, u int")
    got = {tuple(r) for r in masks.dilate(px, 2, 6, 6, "ellipse").collect()}
    want = {(f, v + a, u + b) for f, v, u in ((1, 0, 0), (1, 4, 4), (2, 2, 2)) for a, b in masks.ellipse(2) if 0 <= v + a < 6 and 0 <= u + b < 6}
    assert got == want
    with pytest.raises(ValueError, match="shape"):
        masks.dilate(px, 2, 6, 6, "star")


# Modes


def test_density_modes(spark):
    rng = np.random.default_rng(7)
    wrapped = lambda m, s, n: (((rng.normal(m, s, n) + 180) % 360) - 180).tolist()
    data = {"one": wrapped(40, 8, 4000), "two": wrapped(-100, 6, 3000) + wrapped(-40, 6, 2000), "over": wrapped(170, 6, 2500) + wrapped(-140, 6, 2500), "close": wrapped(0, 5, 3000) + wrapped(12, 5, 3000), "small": wrapped(90, 4, 5000) + wrapped(-90, 4, 400), "few": wrapped(0, 3, 50) + wrapped(100, 3, 49), "none": [float("nan"), None]}
    df = spark.createDataFrame([(k, x) for k, v in data.items() for x in v], "key string, a double")
    got = {r.key: r for r in modes.density_modes(df, ["key"], F.col("a")).collect()}
    assert {k: r.bimodal for k, r in got.items()} == {"one": False, "two": True, "over": True, "close": False, "small": False, "few": False}
    two, over = got["two"], got["over"]
    assert (two.first, two.second, two.separation) == pytest.approx((-100, -40, 60), abs=4) and two.height == pytest.approx(2 / 3, abs=0.12) and two.dip > 0.9
    assert over.separation == pytest.approx(50, abs=4) and {round(x % 360, -1) for x in (over.first, over.second)} == {170, 220}
    assert got["few"].first is None and got["few"].n == 99
    # Close to the sum of kernels over the angles themselves.
    grid = np.radians(np.arange(720) / 2 - 180)
    exact = np.array([np.exp(180 * (np.cos(x - np.radians(data["two"])) - 1)).sum() for x in grid])
    binned = np.array([r.density for r in modes.direction_density(df.filter("key = 'two'"), ["key"], F.col("a")).orderBy("cell").collect()])
    assert len(binned) == 720 and np.abs(binned - exact).max() < 0.02 * exact.max()


# Light


def ground_height(z, grid, x, y):
    fx, fy = (x - grid.x0) / grid.res, (y - grid.y0) / grid.res
    if not (0 <= fx <= grid.nx - 1 and 0 <= fy <= grid.ny - 1):
        return math.nan
    i, j = min(int(fx), grid.nx - 2), min(int(fy), grid.ny - 2)
    wx, wy = fx - i, fy - j
    return (z[j, i] * (1 - wx) + z[j, i + 1] * wx) * (1 - wy) + (z[j + 1, i] * (1 - wx) + z[j + 1, i + 1] * wx) * wy


@pytest.mark.parametrize("blocks", [(64, 8), (16, 4), (5,), ()])
@pytest.mark.parametrize("sun", [(0.8, 0.5, 0.33), (-0.6, 0.0, 0.8), (0.0, -0.9, 0.2), (0.0, 0.0, 1.0)])
def test_shade_is_that_of_all_steps(spark, blocks, sun):
    grid = Grid(100.0, 200.0, 4.0, 50, 30)
    rng = np.random.default_rng(8)
    z = rng.uniform(0, 12, (30, 50))
    z[:, 30] = 40  # a ridge
    z[4, 7] = np.nan
    cells = spark.createDataFrame([(i, j, None if math.isnan(z[j, i]) else float(z[j, i])) for i in range(50) for j in range(30)], "ix int, iy int, z double")
    at = [(k, float(x), float(y), float(h)) for k, (x, y, h) in enumerate(zip(rng.uniform(90, 310, 250), rng.uniform(190, 330, 250), rng.uniform(5, 30, 250), strict=True))]
    points = spark.createDataFrame([*at, (900, None, 1.0, 1.0)], "id long, px double, py double, pz double")
    got = {r.id for r in light.shaded(points, "id", ["px", "py", "pz"], sun, cells, grid, 150.0, 3.0, blocks).collect()}
    want = {k for k, x, y, h in at if any(ground_height(z, grid, x + i * 3 * sun[0], y + i * 3 * sun[1]) > h + i * 3 * sun[2] for i in range(1, 51))}
    assert got == want


def test_a_ridge_shades_what_lies_behind(spark):
    grid = Grid(0.0, 0.0, 1.0, 200, 5)
    cells = spark.range(1000).select((F.col("id") % 200).cast("int").alias("ix"), F.floor(F.col("id") / 200).cast("int").alias("iy")).withColumn("z", F.when(F.col("ix") == 150, 30.0).otherwise(0.0))
    points = spark.range(200).select("id", F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y"), F.lit(0.01).alias("z"))
    sun = (math.sqrt(0.5), 0.0, math.sqrt(0.5))
    got = sorted(r.id for r in light.shaded(points, "id", ["x", "y", "z"], sun, cells, grid, 400.0, 0.1).collect())
    assert set(range(123, 150)) <= set(got) <= set(range(120, 151))  # the ridge is 30 high and the sun at 45 degrees; its foot at 150 is within it
    with pytest.raises(ValueError, match="horizon"):
        light.shaded(points, "id", ["x", "y", "z"], (1.0, 0.0, 0.0), cells, grid)


def test_what_the_ground_hides(spark):
    camera = Camera(10.0, 5.0, 5.0, ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (0.0, 0.0, 0.0), 10, 10)
    points = spark.createDataFrame([(1, 0.0, 0.0, 9.0), (2, 0.0, 0.0, 11.4), (3, 0.0, 0.0, 11.6), (4, 1.0, 0.0, 99.0), (5, 90.0, 0.0, 10.0), (6, 0.0, 0.0, -3.0), (7, 0.0, 0.2, 1.0)], "id int, x double, y double, z double")
    depths = spark.createDataFrame([(5, 5, 10.0), (7, 5, None)], "v int, u int, depth double")
    got = {r.id: (r.cam_v, r.cam_u) for r in light.unhidden(points, ["x", "y", "z"], camera, depths, 1.5).collect()}
    assert got == {1: (5, 5), 2: (5, 5), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None), 7: (7, 5)}


def test_lookups_of_a_grid(spark):
    """Looking straight down on flat ground with the sun at 45 degrees: a voxel is seen at its own place and shades the one beside it, as far as it is high."""
    camera = Camera(1000.0, 20.0, 20.0, ((1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0)), (20.0, 20.0, 1000.0), 41, 41)  # nearly a pixel a metre
    land = spark.range(60 * 41).select((F.col("id") % 60).cast("int").alias("ix"), F.floor(F.col("id") / 60).cast("int").alias("iy"), F.lit(0.0).alias("z"))
    grid = spark.createDataFrame([(v, u, k, 1.0 * u, 1.0 * v, 1.0 * k) for v in (10, 20) for u in (5, 20, 36) for k in (1, 6)], "v int, u int, k int, x double, y double, z double")
    depths = spark.createDataFrame([(30, 5, 900.0)], "v int, u int, depth double")  # something stands before (10, 5)
    rows = light.looked_up(grid, camera, (-math.sqrt(0.5), 0.0, math.sqrt(0.5)), depths, land, Grid(0.0, 0.0, 1.0, 60, 41), 1.0, 100.0).collect()
    assert len(rows) == 12
    for r in rows:
        assert (r.cam_v, r.cam_u) == ((None, None) if (r.v, r.u) == (10, 5) else (40 - r.v, r.u)), r
        assert (r.sun_v, r.sun_u) == ((40 - r.v, r.u + r.k) if r.u + r.k <= 40 else (None, None)), r


@pytest.mark.parametrize("stride", [1, 3])
def test_cast_shadow_is_that_of_all_steps(spark, stride):
    rng = np.random.default_rng(9)
    solid = {(int(v), int(u), int(k)) for v, u, k in rng.integers(0, (9, 8, 7), (40, 3))}
    origin, res, sun = (10.0, 20.0, 1.0), 1.5, (0.5, -0.3, math.sqrt(1 - 0.34))
    ground = [(v, u, u * 0.9, 10 + v * 0.9, 0.1 * u) for v in range(30) for u in range(32)] + [(30, 0, None, None, None)]
    got = {(r.frame, r.v, r.u) for r in light.cast_shadow(spark.createDataFrame(ground, "v int, u int, x double, y double, z double"), spark.createDataFrame([(1, *c) for c in solid], "frame int, v int, u int, k int"), ["frame"], origin, (9, 8, 7), res, sun, stride).collect()}
    dark = set()
    for v, u, x, y, z in ground[:-1]:
        if v % stride == 0 and u % stride == 0:
            way = {tuple(round((p + i * 0.9 * d - o) / res) for p, d, o in zip((x, y, z), sun, origin, strict=True)) for i in range(1, 200)}
            if any((b, a, c) in solid for a, b, c in way):
                dark |= {(1, v + i, u + j) for i in range(stride) for j in range(stride) if (v + i < 30 or (v + i, u + j) == (30, 0)) and u + j < 32}
    assert got == dark and dark


def test_column_shadow(spark):
    ways = spark.createDataFrame([(0, 0, 5, 5), (0, 9, 5, 5), (9, 9, 5, 5), (3, 3, 6, 6), (9, 0, 5, 5)], "v int, u int, gas_v int, gas_u int")
    gas = spark.createDataFrame([(1, 5, 5), (2, 0, 0)], "frame long, v int, u int")
    shadow = spark.createDataFrame([(f, v, u) for f in (1, 2) for v, u in ((0, 0), (0, 9), (9, 9), (3, 3), (9, 0), (5, 6))], "frame long, v int, u int")
    static = spark.createDataFrame([(0, 7)], "v int, u int")
    got = light.column_shadow(shadow, gas, static, ways, 10, 10, 3, 2).collect()
    # Of frame 1: (3, 3) is on no way from its gas, (5, 6) is by the gas, (0, 9) by the fixed shadow.
    assert sorted(map(tuple, got)) == [(1, 0, 0), (1, 9, 0), (1, 9, 9)]


def test_corridor(spark):
    camera = Camera(10.0, 50.0, 50.0, ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, -1.0, 0.0)), (0.0, -10.0, 0.0), 101, 101)  # level, looking north
    ground = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, None, 0.0, 0.0)], "v int, u int, x double, y double, z double")
    rows = sorted(map(tuple, light.corridor(ground, camera, (0.6, 0.0, 0.8), 8.0, 2.5).collect()))
    assert rows == [(0, 0, 50 - round(2.0 * k), 50 + round(1.5 * k)) for k in (4, 3, 2, 1)]


def test_seen_agreement(spark):
    t = lambda rows: spark.createDataFrame(rows, "frame int, v int, u int")
    got = light.seen_agreement(t([(1, 0, 0), (1, 0, 1), (1, 5, 5)]), t([(1, 0, 1), (1, 0, 2), (2, 0, 0)]), t([(1, 0, k) for k in range(4)] + [(2, 0, 0)]), ["frame"])
    assert sorted(map(tuple, got.collect())) == [(1, 2, 2, pytest.approx(1 / 3), 0.5, 0.5), (2, 0, 1, 0.0, 0.0, 0.0)]
