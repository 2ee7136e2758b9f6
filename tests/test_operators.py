"""Operators on small cases with known results."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyplume.functions import circular as C
from skyplume.operators import fits, joins, masks, series
from skyplume.sources import boxes


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_circular_mean_turns_with_its_angles(spark):
    rng = np.random.default_rng(0)
    a = [(float(x), float(w)) for x, w in zip(rng.uniform(0, 360, 50), rng.uniform(0.1, 1, 50), strict=True)]
    df = frame(spark, a, "a double, w double")
    mean, turned, spread, spread_turned = df.agg(C.circular_mean(F.col("a"), F.col("w")), C.circular_mean(F.col("a") + 90, F.col("w")), C.circular_spread(F.col("a")), C.circular_spread(F.col("a") + 90)).first()
    assert turned == pytest.approx((mean + 90) % 360)
    assert spread == pytest.approx(spread_turned)
    x = np.radians([v for v, _ in a])
    w = np.array([v for _, v in a])
    assert mean == pytest.approx(np.degrees(np.arctan2((w * np.sin(x)).sum(), (w * np.cos(x)).sum())) % 360)


def test_circular_mean_of_nothing_is_null(spark):
    assert frame(spark, [], "a double").agg(C.circular_mean(F.col("a"))).first()[0] is None
    assert frame(spark, [(None,)], "a double").agg(C.circular_mean(F.col("a"))).first()[0] is None


def test_difference_is_signed(spark):
    got = frame(spark, [(10.0, 350.0), (350.0, 10.0), (180.0, 0.0), (0.0, 180.0)], "a double, b double").select(C.difference(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [20, -20, -180, -180]


def test_edge_mean_is_numpy_with_edge_padding(spark):
    x = np.random.default_rng(1).normal(size=20)
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 5.0)], "k int, i int, x double")
    got = df.select("k", "i", series.edge_mean(F.col("x"), 5, ["k"], ["i"]).alias("m"), series.edge_median(F.col("x"), 5, ["k"], ["i"]).alias("d")).orderBy("k", "i").collect()
    padded = np.pad(x, 2, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, 5)
    assert [r.m for r in got[:20]] == pytest.approx(windows.mean(axis=1).tolist())
    assert [r.d for r in got[:20]] == pytest.approx(np.median(windows, axis=1).tolist())
    assert got[20].m == 5 and got[20].d == 5


def test_fill_linear_is_numpy_interp(spark):
    y = [None, 2.0, None, None, 8.0, None]
    df = frame(spark, [(1, i, v) for i, v in enumerate(y)], "k int, x int, y double")
    got = [r.filled for r in series.fill_linear(df, "x", "y", ["k"]).orderBy("x").collect()]
    assert got == pytest.approx(np.interp(range(6), [1, 4], [2, 8]).tolist())
    assert series.fill_linear(frame(spark, [(1, 0, None)], "k int, x int, y double"), "x", "y", ["k"]).first().filled is None


def test_first_sustained_needs_two_rows_and_the_closed_end(spark):
    rows = [(1, 0, 9), (1, 10, 1), (1, 20, 9), (1, 25, 9), (1, 30, 9), (1, 41, 0), (2, 0, 9)]
    df = frame(spark, rows, "k int, t long, v int")
    got = {r.k: r.first_at for r in series.first_sustained(df, "v", 5, "t", 10, ["k"], "above").collect()}
    assert got == {1: 20, 2: None}
    nulls = frame(spark, [(1, 0, None), (1, 5, 9)], "k int, t long, v int")
    assert series.first_sustained(nulls, "v", 5, "t", 10, ["k"], "above").first().first_at is None


def test_longest_run_takes_the_first_of_equals(spark):
    df = frame(spark, [(1, i, v) for i, v in enumerate([1, 1, 0, 1, 1, 0, 1])], "k int, i int, v int")
    r = series.longest_run(df, F.col("v") == 1, ["k"], ["i"]).first()
    assert (r.run_start, r.run_stop, r.run_rows) == (0, 1, 2)


def test_episodes_keep_long_or_strong_ones(spark):
    level = [0, 5, 0, 5, 0, 0, 0, 0, 0, 0, 5, 0, 0, 0, 0, 0, 0, 9]
    df = frame(spark, [(1, i, v) for i, v in enumerate(level)], "k int, i int, v int")
    got = sorted((r.first_row, r.last_row, r.peak, r.strength) for r in series.episodes(df, "i", "v", 4, 5, ["k"]).collect())
    assert got == [(1, 3, 5, -2), (17, 17, 9, 5)]


def test_quiet_window_falls_back_to_the_lowest(spark):
    df = frame(spark, [(1, i, v) for i, v in enumerate([9, 1, 1, 9, 1, 1, 9])] + [(2, i, v) for i, v in enumerate([9, 8, 9])], "k int, i int, v int")
    got = {r.k: (r.start_row, r.is_calm) for r in series.quiet_window(df, "i", "v", 2, 2, ["k"]).collect()}
    assert got == {1: (4, True), 2: (0, False)}


def test_gradient_is_numpy_gradient(spark):
    x = np.random.default_rng(2).normal(size=9)
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, x double")
    got = [r.g for r in df.withColumn("g", series.gradient("x", ["k"], ["i"])).orderBy("i").collect()]
    assert got == pytest.approx(np.gradient(x).tolist())


def test_unwrap_is_numpy_unwrap(spark):
    x = np.cumsum(np.random.default_rng(3).uniform(-170, 170, 30)) % 360
    df = frame(spark, [(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, x double")
    got = [r.unwrapped for r in series.unwrap(df, "x", ["k"], ["i"]).orderBy("i").collect()]
    assert got == pytest.approx(np.unwrap(x, period=360).tolist())


def test_bracketed_is_strict_on_the_left(spark):
    s = frame(spark, [(0, 1.0), (10, 2.0), (50, 3.0)], "t long, v double")
    q = frame(spark, [(1, 0), (2, 5), (3, 10), (4, 30), (5, 60)], "id int, at long")
    got = {r.id: (r.status, r.interpolated) for r in joins.bracketed(q, "id", "at", s, "t", "v", 20).collect()}
    assert got == {1: ("before", None), 2: ("ok", 1.5), 3: ("ok", 2.0), 4: ("gap", None), 5: ("after", None)}


def test_nearest_breaks_ties_by_id_and_keeps_the_tolerance(spark):
    a = frame(spark, [("x", 1, 100), ("x", 2, 200)], "k string, id int, at long")
    b = frame(spark, [("x", 8, 110), ("x", 7, 90), ("x", 9, 211), ("y", 1, 100)], "k string, rid int, rat long")
    got = joins.nearest(a, "id", "at", b, "rid", "rat", 10, ["k"]).collect()
    assert [tuple(r) for r in got] == [(1, 7, 10)]


def test_power_law_finds_its_exponent(spark):
    t = np.arange(1, 40, dtype=float)
    df = frame(spark, [("a", float(x), float(3 + 2 * x**1.5)) for x in t] + [("b", float(x), float(5 * x**2 - 4)) for x in t], "g string, t double, y double")
    got = {r.g: r for r in fits.power_law(df, ["g"], "t", "y").collect()}
    assert got["a"].alpha == pytest.approx(1.5) and got["a"].k == pytest.approx(2) and got["a"].s0 == pytest.approx(3)
    assert got["b"].s0 >= 0  # never negative


def test_weighted_moments_are_numpy_cov(spark):
    rng = np.random.default_rng(4)
    u, v, w = rng.normal(size=(2, 40)).tolist() + [rng.integers(1, 5, 40).tolist()]
    df = frame(spark, [("a", *x) for x in zip(u, v, w, strict=True)] + [("z", 1.0, 1.0, 0)], "k string, u double, v double, w int")
    got = {r.k: r for r in fits.weighted_moments(df, ["k"], F.col("u"), F.col("v"), F.col("w")).collect()}
    want = np.cov(np.array([u, v]), fweights=w, ddof=0)
    assert [got["a"].var_u, got["a"].var_v, got["a"].cov_uv] == pytest.approx([want[0, 0], want[1, 1], want[0, 1]])
    assert got["z"].mean_u is None


def test_mask_operators(spark):
    grid = np.array([[1, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1], [0, 0, 0, 0]])
    px = frame(spark, [(1, int(v), int(u)) for v, u in zip(*np.nonzero(grid), strict=True)], "frame long, v int, u int")
    r = masks.largest_component(px).first()
    assert (r.n_components, r.largest) == (3, 2)
    grown = {(x.v, x.u) for x in masks.dilate(px, 1, 4, 4).collect()}
    want = {(v + a, u + b) for v, u in zip(*np.nonzero(grid), strict=True) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= v + a < 4 and 0 <= u + b < 4}
    assert grown == want
    assert masks.overlap(px, px).first().iou == 1
    far = masks.farthest_points(px, 9).collect()
    assert len(far) == 5 and len({(x.v, x.u) for x in far}) == 5
    empty = px.filter("false")
    assert masks.largest_component(empty).count() == 0 and masks.overlap(px, empty).first().dice == 0


def test_boxes(spark, tmp_path):
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    mvhd = box(b"mvhd", struct.pack(">IIII", 0, boxes.EPOCH_1904 + 86400, 0, 0))
    data = box(b"ftyp", b"isom") + box(b"moov", mvhd + box(b"trak", box(b"mdia", b"")))
    (tmp_path / "a.mp4").write_bytes(data)
    (tmp_path / "b.mp4").write_bytes(b"\x00\x00\x00\xffjunk")
    got = {r.box: r for r in boxes.read_boxes(spark, str(tmp_path)).collect()}
    assert set(got) == {"/ftyp", "/moov", "/moov/mvhd", "/moov/trak", "/moov/trak/mdia"}
    assert got["/moov/mvhd"].created.isoformat() == "1970-01-02T00:00:00"
    assert data[got["/ftyp"].offset :][: got["/ftyp"].size] == b"isom"
