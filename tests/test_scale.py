"""Operators that take another way for large keys or dense series: both ways against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.operators import fits, joins, quantiles


@pytest.mark.parametrize("bound", [100_000, 40, 1])
def test_quantiles_of_small_and_large_keys(spark, bound):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=500).tolist(), "b": rng.integers(0, 5, 300).astype(float).tolist(), "c": [3.0], None: rng.normal(size=90).tolist(), "d": [1.0, 2.0], "e": [None, float("nan"), float("inf")], "f": [7.0] * 200}
    df = spark.createDataFrame([(k, x) for k, v in data.items() for x in [*v, None, float("nan")]], "key string, x double").repartition(3)
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.key: list(r)[1:] for r in quantiles.quantiles(df, ["key"], F.col("x"), qs, ["q0", "q1", "q5", "q9", "qx"], bound).collect()}
    want = {k: np.percentile([x for x in v if x is not None and math.isfinite(x)], [100 * q for q in qs]).tolist() for k, v in data.items() if k != "e"}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def plain_bracket(points, t, gap):
    """Status and value by looking at all points of the key."""
    if not points:
        return "none", None
    times = [p[0] for p in points]
    if t <= min(times):
        return "before", None
    if t > max(times):
        return "after", None
    p, n = max(x for x in points if x[0] < t), min(x for x in points if x[0] >= t)
    return ("ok", p[1] + (t - p[0]) / (n[0] - p[0]) * (n[1] - p[1])) if n[0] - p[0] <= gap else ("gap", None)


@pytest.mark.parametrize("gap", [1, 7, 50, 1000])
def test_neighbours_in_time(spark, gap):
    """Dense and sparse series, ties, queries on points, bucket edges, negative times, keys without points or null."""
    rng = random.Random(gap)
    series = {"dense": [(t, rng.uniform(0, 9)) for t in range(-60, 60)], "sparse": [(rng.randint(-300, 300), rng.uniform(0, 9)) for _ in range(25)], "one": [(5, 1.0)], "ties": [(t, rng.uniform(0, 9)) for t in (0, 0, 7, 7, 14, 21, 50) for _ in range(2)]}
    asked = [(k, t) for k in ("dense", "sparse", "one", "ties", "none") for t in sorted({rng.randint(-320, 320) for _ in range(60)} | {-60, 0, 5, 7, 14, 49, 50, 51})]
    queries = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(asked)] + [(9999, None, 3)], "id long, key string, at long")
    points = spark.createDataFrame([(k, t, v) for k, s in series.items() for t, v in s] + [(None, 2, 1.0), (None, 4, 1.0), ("dense", None, 1.0)], "key string, t long, v double")
    rows = {r.id: (r.status, r.interpolated) for r in joins.bracketed(queries, "id", "at", points, "t", "v", gap, ["key"]).collect()}
    assert len(rows) == len(asked) + 1 and rows.pop(9999) == ("none", None)
    for i, (k, t) in enumerate(asked):
        status, value = plain_bracket(series.get(k, []), t, gap)
        assert rows[i][0] == status, (k, t)
        assert rows[i][1] == (None if value is None else pytest.approx(value)), (k, t)


def test_neighbours_without_keys(spark):
    queries = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 0)], "id long, at long")
    points = spark.createDataFrame([(0, 1.0, 350.0), (10, 3.0, 10.0)], "t long, v double, d double")
    rows = {r.id: (r.status, r.interpolated, None if r.direction is None else round(r.direction, 6) % 360) for r in joins.bracketed(queries, "id", "at", points, "t", "v", 20, direction="d").collect()}
    assert rows == {1: ("ok", 2.0, 0.0), 2: ("ok", 3.0, 10.0), 3: ("after", None, None), 4: ("before", None, None)}


def test_world_sigmas_in_one_pass(spark):
    """A cloud some kilometres from the map's origin, seen obliquely: spread and axis are those of its points."""
    camera = Camera.at(1400.0, (352_500.0, 7_214_400.0, 1120.0), 30.0, -35.0, 1920, 1080)
    rng = np.random.default_rng(2)
    rows = [(1, float(u), float(v), float(w)) for u, v, w in zip(rng.normal(900, 60, 400), rng.normal(600, 40, 400), rng.uniform(-0.2, 1, 400), strict=True)] + [(2, 900.0, 600.0, 1.0)] * 20 + [(1, 900.0, -9000.0, 1.0), (1, None, 3.0, 1.0), (1, 900.0, 600.0, float("nan"))]
    got = fits.world_sigmas(spark.createDataFrame(rows, "frame int, u double, v double, w double"), ["frame"], camera, F.lit(1000.0), F.col("w")).collect()
    assert [r.frame for r in got] == [1]

    def ground(u, v):
        d = np.array(camera.axes) @ [(u - camera.cx) / camera.focal, (v - camera.cy) / camera.focal, 1.0]
        t = (1000.0 - camera.centre[2]) / d[2]
        return np.array(camera.centre[:2]) + t * d[:2] if t > 0 else None

    at, weight = [], []
    for _, u, v, w in rows:
        if u is not None and w > 0 and rows[0][0] == 1:
            p = ground(u, v)
            if p is not None and _ == 1:
                a, b = ground(u + 0.5, v) - p, ground(u, v + 0.5) - p
                at.append(p)
                weight.append(4 * w * abs(a[0] * b[1] - a[1] * b[0]))
    at, weight = np.array(at), np.array(weight)
    mean = (weight[:, None] * at).sum(axis=0) / weight.sum()
    cov = ((at - mean).T * weight) @ (at - mean) / weight.sum()
    small, large = np.linalg.eigvalsh(cov)
    r = got[0]
    assert r.n_used == len(at) and (r.east, r.north) == pytest.approx(tuple(mean), abs=1e-6) and (r.major, r.minor) == pytest.approx((math.sqrt(large), math.sqrt(small)), rel=1e-7)
    x, y = np.linalg.eigh(cov)[1][:, 1]
    assert r.azimuth == pytest.approx(math.degrees(math.atan2(x, y)) % 180, abs=1e-6)
