"""Guards, quantiles, cameras, terrain, masks over frames, files: against NumPy and known truth."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyplume.functions import camera, circular, guards, maps, physics
from skyplume.operators import fits, gates, images, joins, masks, quantiles, rasters, sampling, series
from skyplume.sinks import text as sinks
from skyplume.sources import boxes, folder, records, stations

NAN, INF = float("nan"), float("inf")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# NaN


def test_guards(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, None, NAN, INF, -INF, 7.0)], "x double")
    x = F.col("x")
    got = df.select(guards.is_finite(x).alias("f"), guards.finite(x).alias("v"), guards.above(x, 5).alias("a"), guards.below(x, 5).alias("b")).collect()
    assert [tuple(r) for r in got] == [(True, 1.0, False, True), (False, None, False, False), (False, None, False, False), (False, None, True, False), (False, None, False, True), (True, 7.0, True, False)]


@pytest.mark.parametrize("values", [[10.0, 20.0, NAN], [NAN, None, INF], []])
def test_circular_statistics_skip_nan(spark, values):
    df = spark.createDataFrame([(v, 1.0) for v in values], "a double, w double")
    mean, spread, weighted = df.agg(circular.circular_mean(F.col("a")), circular.circular_spread(F.col("a")), circular.circular_mean(F.col("a"), F.col("w"))).first()
    if len(values) and values[0] == 10.0:
        assert mean == pytest.approx(15) and weighted == pytest.approx(15) and spread == pytest.approx(5, abs=0.01)
    else:
        assert mean is None and spread is None and weighted is None


def test_sustained_crossing_does_not_start_or_go_on_with_nan(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in enumerate([1.0, NAN, NAN, 8.0, 9.0])] + [("b", t, NAN) for t in range(3)], "k string, t long, v double")
    got = {r.k: r.first_at for r in series.first_sustained(df, "v", 5, "t", 1, ["k"], "above").collect()}
    assert got == {"a": 3, "b": None}
    later = {r.k: r.first_at for r in series.first_sustained(df, "v", 5, "t", 0, ["k"], "above", F.lit(4)).collect()}
    assert later["a"] is None  # one row only


def test_episodes_and_fill_skip_nan(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 9.0, NAN, 9.0, 1.0])], "k string, i long, v double")
    r = series.episodes(df, "i", "v", 4.0, 3, ["k"]).first()
    assert (r.first_row, r.last_row, r.peak, r.strength) == (1, 3, 9.0, 10.0)
    assert [r.filled for r in series.fill_linear(df, "i", "v", ["k"]).orderBy("i").collect()] == [1.0, 9.0, 9.0, 9.0, 1.0]


# Quantiles


def test_quantiles_are_numpy_percentiles(spark):
    rng = np.random.default_rng(0)
    data = [("a", float(x)) for x in rng.normal(size=3001)] + [("b", float(x)) for x in rng.integers(0, 5, 400)] + [("c", 3.5), (None, 1.0), (None, 2.0), ("d", NAN), ("e", None)]
    got = {r.k: r for r in quantiles.quantiles(spark.createDataFrame(data, "k string, x double"), ["k"], F.col("x"), [0, 0.1, 0.5, 0.98, 1], list("pqrst")).collect()}
    for k in ("a", "b", "c", None):
        want = np.percentile([x for key, x in data if key == k], [0, 10, 50, 98, 100])
        assert [got[k][c] for c in "pqrst"] == pytest.approx(want.tolist())
    assert set(got) == {"a", "b", "c", None}


def test_quantiles_hold_no_large_key_in_one_buffer(spark):
    plan = quantiles.sliced(spark.range(10).select(F.lit(1).alias("k"), F.col("id").alias("x")), ["k"], F.col("x"), [0.5], ["m"])._jdf.queryExecution().toString()
    assert "percentile(" not in plan.replace("approx_percentile(", "").replace("percentile_approx(", "")


# Series


def test_edge_mean_of_short_series(spark):
    data = {k: list(range(1, k + 1)) for k in (1, 2, 4, 6, 9)}
    df = spark.createDataFrame([(k, i, float(v * v)) for k, vs in data.items() for i, v in enumerate(vs)], "k long, i long, v double")
    got = {}
    for r in df.select("k", "i", series.edge_mean(F.col("v"), 7, ["k"], ["i"]).alias("m")).collect():
        got[(r.k, r.i)] = r.m
    for k, vs in data.items():
        x, w = np.array(vs, float) ** 2, min(7, k)
        for i in range(k):
            at = np.clip(np.arange(i - w // 2, i - w // 2 + w), 0, k - 1)
            assert got[(k, i)] == pytest.approx(x[at].mean())


def test_high_pass_lets_fast_changes_through(spark):
    t = np.arange(400)
    slow, fast = np.sin(t / 60), np.sin(t * 2.2)
    df = spark.createDataFrame([(0, int(i), float(x)) for i, x in zip(t, slow + fast, strict=True)], "px long, frame long, v double")
    got = np.array([r.passed for r in series.high_pass(df, ["px"], ["frame"], "v", 0.2).orderBy("frame").collect()])
    assert np.abs(got - fast)[40:-40].max() < 0.05
    flat = spark.createDataFrame([(0, i, 5.0) for i in range(30)] + [(1, 0, NAN)], "px long, frame long, v double")
    assert max(abs(r.passed) for r in series.high_pass(flat, ["px"], ["frame"], "v", 0.2).collect()) < 1e-9


def test_plateau_needs_three_full_rows(spark):
    df = spark.createDataFrame([("a", t, h, v) for t, h, v in [(0, 1.0, 10.0), (1, 5.0, 90.0), (2, 9.5, 95.0), (3, 10.0, 100.0), (4, NAN, 100.0)]] + [("b", 0, 1.0, 100.0), ("b", 1, 2.0, 1.0)], "k string, t long, h double, v double")
    got = {r.k: r for r in series.plateau(df, "t", "h", "v", ["k"]).collect()}
    assert (got["a"].plateau, got["a"].since) == (9.75, 2) and (got["b"].plateau, got["b"].since) == (2.0, 1)


# Geometry


def test_camera_sees_what_it_projects(spark):
    cam = camera.Camera.at(1000.0, (10.0, 20.0, 100.0), 70.0, -40.0, 800, 600)
    r = np.array(cam.axes)
    assert np.allclose(r.T @ r, np.eye(3)) and np.linalg.det(r) == pytest.approx(1)
    assert r[:, 2] == pytest.approx([math.sin(math.radians(70)) * math.cos(math.radians(40)), math.cos(math.radians(70)) * math.cos(math.radians(40)), -math.sin(math.radians(40))])
    df = spark.createDataFrame([(100.0, 200.0), (400.0, 300.0), (799.0, 599.0), (400.0, -5000.0)], "u double, v double")
    x, y = cam.on_plane(F.col("u"), F.col("v"), F.lit(5.0))
    back = df.select("u", "v", x.alias("x"), y.alias("y")).select("*", *[c.alias(n) for c, n in zip(cam.pixel(F.col("x"), F.col("y"), F.lit(5.0)), ("u2", "v2"), strict=True)]).collect()
    for b in back[:3]:
        assert (b.u2, b.v2) == (pytest.approx(b.u), pytest.approx(b.v))
    assert back[3].x is None  # above the horizon
    behind = df.limit(1).select(*[c.alias(n) for c, n in zip(cam.pixel(F.lit(-90.0), F.lit(-20.0), F.lit(100.0)), "uv", strict=True)]).first()
    assert behind.u is None


def test_rays_in_a_box(spark):
    df = spark.createDataFrame([(0.0, 0.0, -5.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (9.0, 9.0, 9.0, 0.0, 0.0, 1.0), (0.0, 0.0, -5.0, 0.0, 0.0, -1.0)], "a double, b double, c double, d double, e double, f double")
    near, far = camera.box_span([F.col(x) for x in "abc"], [F.col(x) for x in "def"], [-1.0, -1.0, -1.0], [1.0, 2.0, 3.0])
    assert [tuple(r) for r in df.select(near, far).collect()] == [(4.0, 8.0), (0.0, 1.0), (None, None), (None, None)]


def test_sun(spark):
    """At the equator at an equinox's noon the sun is overhead; at the solstice it stands over the tropic."""
    day = lambda s: (np.datetime64(s) - np.datetime64("2000-01-01T12:00")) / np.timedelta64(1, "D")
    df = spark.createDataFrame([(float(day("2024-03-20T12:07")),), (float(day("2024-06-20T12:02")),), (float(day("2024-06-20T00:00")),)], "d double")
    az, el = physics.sun(F.col("d"), 0.0, 0.0)
    got = df.select(az.alias("az"), el.alias("el")).collect()
    assert got[0].el > 89 and got[1].el == pytest.approx(90 - 23.44, abs=0.2) and min(got[1].az, 360 - got[1].az) < 3 and got[2].el < 0


def test_world_sigmas_find_a_known_cloud(spark):
    cam = camera.Camera.at(1200.0, (0.0, 0.0, 300.0), 0.0, -89.9, 2000, 2000)
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 20, 6000), rng.normal(0, 5, 6000)
    a = math.radians(30)
    east, north = x * math.sin(a) + y * math.cos(a), x * math.cos(a) - y * math.sin(a)
    pts = spark.createDataFrame([(float(e), float(n)) for e, n in zip(east, north, strict=True)], "x double, y double")
    u, v = cam.pixel(F.col("x"), F.col("y"), F.lit(0.0))
    r = fits.world_sigmas(pts.select(F.lit(1).alias("k"), u.alias("u"), v.alias("v")), ["k"], cam, F.lit(0.0), F.lit(1.0)).first()
    assert r.major == pytest.approx(x.std(), rel=0.02) and r.minor == pytest.approx(y.std(), rel=0.02) and r.azimuth == pytest.approx(30, abs=1)


def test_growth_goes_on_in_a_line(spark):
    df = spark.createDataFrame([(t,) for t in (4.0, 10.0, 10.001, 20.0)], "t double")
    got = [r.s for r in df.select(physics.grown_sigma(F.col("t"), F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit(10.0)).alias("s")).collect()]
    assert got[0] == pytest.approx(3) and got[1] == pytest.approx(51**0.5) and got[2] == pytest.approx(got[1], abs=1e-3) and got[3] == pytest.approx((51 + 10 * 10) ** 0.5)


# Terrain

GRID = rasters.Grid(0.0, 0.0, 10.0, 30, 20)


def plane(spark, a=0.5, b=-0.2, c=10.0):
    return spark.createDataFrame([(i, j, a * i * 10 + b * j * 10 + c) for i in range(30) for j in range(20)], "ix int, iy int, z double")


def test_bilinear_and_nearest_on_a_plane(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 123.4, 77.7), (2, 290.0, 190.0), (3, 291.0, 5.0), (4, 25.0, 15.0)], "id long, x double, y double")
    got = {r.id: r.z for r in rasters.bilinear(pts, GRID, plane(spark), "id", "x", "y").collect()}
    assert [got[k] for k in (0, 1, 2, 4)] == pytest.approx([10 + 0.5 * x - 0.2 * y for x, y in ((0, 0), (123.4, 77.7), (290, 190), (25, 15))]) and got[3] is None
    near = {r.id: r.z for r in rasters.nearest(pts, GRID, plane(spark), "x", "y", "z").collect()}
    assert near[4] == pytest.approx(10 + 0.5 * 20 - 0.2 * 20)  # halves go to even
    assert near[3] == pytest.approx(10 + 0.5 * 290 - 0.2 * 0) or near[3] == 0


def test_rays_hit_a_plane(spark):
    rays = spark.createDataFrame([(0, 50.0, 60.0, 200.0, 0.1, 0.2, -1.0), (1, 50.0, 60.0, 200.0, 0.0, 0.0, 1.0), (2, 50.0, 60.0, 0.0, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, dx double, dy double, dz double")
    args = ("id", ["x", "y", "z"], ["dx", "dy", "dz"], plane(spark), GRID, 5.0, 500.0)
    down = {r.id: r for r in rasters.ray_hits(rays, *args, crossing="down").collect()}
    t = (200 - (10 + 0.5 * 50 - 0.2 * 60)) / (1 + 0.5 * 0.1 - 0.2 * 0.2)
    assert (down[0].x, down[0].y) == (pytest.approx(50 + 0.1 * t), pytest.approx(60 + 0.2 * t)) and down[1].t is None and down[2].t is None
    any_ = {r.id: r for r in rasters.ray_hits(rays, *args).collect()}
    assert any_[2].z == pytest.approx(10 + 25 - 12)


# Masks


def test_components_are_those_of_a_flood(spark):
    rng = np.random.default_rng(2)
    for steps, dim in ((masks.AROUND, 2), (masks.FACES, 3)):
        on = np.argwhere(rng.random((9,) * dim) < 0.4)
        label = masks.component_labels(on, steps)
        around = {tuple(s) for s in steps} | {tuple(-s) for s in steps}
        place = {tuple(p): k for k, p in enumerate(on.tolist())}
        seen = {}
        for p in place:
            stack = [p]
            while stack:
                q = stack.pop()
                if q in seen:
                    continue
                seen[q] = place[p]
                stack += [r for s in around if (r := tuple(np.add(q, s).tolist())) in place]
        assert label.tolist() == [seen[tuple(p)] for p in on.tolist()]


def test_empty_frames_agree(spark):
    px = spark.createDataFrame([(1, 0, 0)], "frame long, v int, u int")
    frames = spark.createDataFrame([(1,), (2,)], "frame long")
    assert rows(masks.overlap(px, px.filter("false"), frames)) == [(1, 0.0, 0.0), (2, 1.0, 1.0)]


def test_bits_round_trip(spark):
    px = spark.createDataFrame([(1, 0, 0), (1, 2, 4), (1, 1, 3), (2, 2, 4)], "frame long, v int, u int")
    bits = masks.packed(px, 3, 5)
    held = {r.frame: np.unpackbits(np.frombuffer(r.bits, np.uint8))[:15].reshape(3, 5) for r in bits.collect()}
    assert sorted((f, int(v), int(u)) for f, m in held.items() for v, u in np.argwhere(m)) == rows(px) == rows(masks.unpacked(bits))


def test_polygons_by_even_odd(spark):
    star = [[1.0, 1.0], [8.0, 1.0], [8.0, 8.0], [1.0, 8.0], [1.0, 3.0], [6.0, 3.0], [6.0, 6.0], [3.0, 6.0], [3.0, 1.0]]
    df = spark.createDataFrame([(1, star), (2, [[0.0, 0.0]])], "id long, points array<array<double>>")
    got = {(r.v, r.u) for r in masks.polygon_pixels(df, ["id"], "points", 10, 10).collect()}

    def inside(u, v):
        odd = False
        for (x0, y0), (x1, y1) in zip(star, star[1:] + star[:1], strict=True):
            if (y0 <= v) != (y1 <= v) and u < x0 + (v - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
        return odd

    assert got == {(v, u) for v in range(10) for u in range(10) if inside(u, v)}
    areas = {r.id: r.a for r in df.select("id", records.polygon_area(F.col("points")).alias("a")).collect()}
    x, y = np.array(star).T
    assert areas == {1: pytest.approx(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2), 2: 0.0}


def test_sobel_of_a_ramp(spark):
    px = spark.createDataFrame([(1, v, u, float(3 * u)) for v in range(6) for u in range(6)], "frame long, v int, u int, value double")
    got = {(r.v, r.u): r.value for r in images.edges(px, 6, 6).collect()}
    assert len(got) == 36 and got[(2, 2)] == pytest.approx(24.0**2) and got[(2, 0)] == pytest.approx(12.0**2)


def test_shift_finds_a_move(spark):
    rng = np.random.default_rng(1)
    img = rng.random((12, 12))
    ref = spark.createDataFrame([(v, u, float(img[v, u])) for v in range(12) for u in range(12)], "v int, u int, value double")
    moved = spark.createDataFrame([(7, v, u, float(img[v + 2, u - 1]) * 3 + 1) for v in range(10) for u in range(1, 12)], "frame long, v int, u int, value double")
    r = images.shift(moved, ref, 2).first()
    assert (r.dv, r.du) == (2, -1) and r.correlation == pytest.approx(1)


# Joins, samples, gates


def test_wind_between_north_and_north(spark):
    s = spark.createDataFrame([("a", 0, 4.0, 350.0), ("a", 10, 8.0, 10.0), ("a", 100, 8.0, 10.0)], "k string, t long, v double, d double")
    q = spark.createDataFrame([(1, "a", 5), (2, "a", 0), (3, "a", 101), (4, "a", 50), (5, "b", 5), (6, "a", 10)], "id long, k string, at long")
    got = {r.id: r for r in joins.bracketed(q, "id", "at", s, "t", "v", 20, ["k"], "d").collect()}
    assert {i: r.status for i, r in got.items()} == {1: "ok", 2: "before", 3: "after", 4: "gap", 5: "none", 6: "ok"}
    assert got[1].interpolated == 6 and min(got[1].direction, 360 - got[1].direction) < 1e-9 and got[4].direction is None


def test_coverage_verdicts(spark):
    s = spark.createDataFrame([("a", t) for t in (0, 1, 2, 3, 50)] + [("b", None)], "k string, t long")
    got = {(r.k, r.instant): r.verdict for r in joins.coverage(s, ["k"], "t", [2, 20, 50, -1, 51], 3, 3).collect()}
    assert [got["a", i] for i in (2, 20, 50, -1, 51)] == ["full", "hole", "partial", "before", "after"] and got["b", 2] == "empty"


def test_samples(spark):
    df = spark.createDataFrame([(k, i) for k in range(3) for i in range(5 if k else 100)], "k long, i long")
    a = rows(sampling.without_replacement(df, ["k"], ["i"], 20, 1))
    assert a == rows(sampling.without_replacement(df.repartition(5), ["k"], ["i"], 20, 1)) and len(a) == 30
    assert a != rows(sampling.without_replacement(df, ["k"], ["i"], 20, 2))
    b = rows(sampling.with_replacement(df, ["k"], ["i"], 50))
    assert len(b) == 150 and len({r[0] for r in b if r[0]}) == 2


def test_gates(spark):
    df = spark.createDataFrame([("ok",), ("doubtful",), (None,)], "grade string")
    assert [r.warned for r in gates.gated(df, F.col("grade") == "ok", "no", False).collect()] == [False, True, True]
    with pytest.raises(Exception, match="bad wind"):
        gates.gated(df, F.col("grade") == "ok", "bad wind").collect()
    assert gates.gated(df.limit(1), F.col("grade") == "ok", "bad wind").count() == 1


def test_maps(spark):
    df = spark.createDataFrame([({"GSD": 2.0, "x": 1.0},), ({"Scale": 3.0},), ({},), (None,)], "m map<string,double>")
    assert [r[0] for r in df.select(maps.first_of(F.col("m"), ["gsd", "scale"])).collect()] == [2.0, 3.0, None, None]
    merged = spark.range(1).select(joins.merged_origins(F.create_map(F.lit("a"), F.lit("file"), F.lit("b"), F.lit("x")), F.create_map(F.lit("a"), F.lit("set by hand: 3"), F.lit("c"), F.lit("y"))).alias("m")).first().m
    assert merged == {"a": "file", "b": "x", "c": "y"}


# Files


def write(path, text, encoding="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_station_series(spark, tmp_path):
    good = write(tmp_path / "a/dir.csv", "FECHA;HORA;valor de dirección\n240101;0000;12,5;\n240101;0100;;\n;;;\nxx\n240101;0200;7.25\n240101;0200;8;\n")
    got = [(str(r.ts), r.value) for r in stations.read_series(spark, good).orderBy("ts").collect()]
    assert [t for t, _ in got] == ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 02:00:00"] and got[0][1] == 12.5 and math.isnan(got[1][1]) and got[2][1] == 8.0
    rose = write(tmp_path / "b/rose.csv", "FECHA;HORA;valor\nN;22,5;3,1\n")
    with pytest.raises(Exception, match="not a time series"):
        stations.read_series(spark, rose).collect()


def test_month_tables(spark, tmp_path):
    page = lambda ff, body: f"<html><table><tr><th>Fecha</th><th>Hora</th><th>dd</th><th>{ff}</th></tr>{body}</table><table><tr><td>x</td></tr></table></html>"
    line = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    write(tmp_path / "m/e_2024-01.xls", page("ff (kt)", line("01-01-2024", "00:00", "90", "10") + line("bad", "00:00", "1", "1") + line("02-01-2024", "01:00", "x", "")))
    write(tmp_path / "m/e_2024-02.xls", page("ff", line("01-01-2024", "00:00", "180", "3")))
    t = stations.read_months(spark, str(tmp_path / "m/*.xls"))
    got = {(r.file.rsplit("/", 1)[1], str(r.ts)): r for r in t.collect()}
    assert len(got) == 3 and got["e_2024-01.xls", "2024-01-01 00:00:00"].vel == pytest.approx(5.14444) and math.isnan(got["e_2024-01.xls", "2024-01-02 01:00:00"].dir)
    one = {str(r.ts): r for r in stations.joined_months(t.withColumn("k", F.lit(1)), ["k"]).collect()}
    assert one["2024-01-01 00:00:00"].dir == 180 and one["2024-01-01 00:00:00"].misnamed and not one["2024-01-02 01:00:00"].misnamed
    write(tmp_path / "n/e.xls", "<table><tr><td>fecha</td></tr></table>")
    with pytest.raises(Exception, match="no columns"):
        stations.read_months(spark, str(tmp_path / "n/*.xls")).collect()


def test_station_files(spark):
    at = "2024-01-0"
    files = spark.createDataFrame([("/d/st_1/DIR_old.CSV", 60000, at + "1"), ("/d/st_1/dir_new.csv", 70000, at + "2"), ("/d/st_1/dir_small.csv", 10, at + "3"), ("/d/vel_st_2.csv", 10, at + "1"), ("/d/vel-abc.csv", 10, at + "1"), ("/d/st_1/vel.csv", 5, at + "1")], "path string, length long, modified string")
    st = spark.createDataFrame([("st_1", "st_1"), ("abc_3", "abc_3")], "id string, folder string")
    got = rows(stations.station_files(files, st, {"dir": ".*dir.*[.]csv", "vel": ".*vel.*[.]csv"}, "d").select("id", "kind", "path", "origin", "place"))
    assert got == [("abc_3", "vel", "/d/vel-abc.csv", "loose", 1), ("st_1", "dir", "/d/st_1/DIR_old.CSV", "folder", 2), ("st_1", "dir", "/d/st_1/dir_new.csv", "folder", 1), ("st_1", "vel", "/d/st_1/vel.csv", "folder", 1)]


def test_sample_tables():
    def box(kind, body):
        return struct.pack(">I4s", 8 + len(body), kind) + body

    def file(stsz, chunks):
        stbl = box(b"stsd", b"....djmd") + box(b"stsz", stsz) + chunks + box(b"stsc", struct.pack(">II", 0, 2) + struct.pack(">6I", 1, 2, 1, 2, 1, 1))
        return box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stbl)))))

    stco = box(b"stco", struct.pack(">II2I", 0, 2, 100, 200))
    co64 = box(b"co64", struct.pack(">II2Q", 0, 2, 100, 2**33))
    each = struct.pack(">III", 0, 0, 3) + struct.pack(">3I", 5, 6, 7)
    assert boxes.sample_table(file(each, stco), b"djmd") == [(100, 5), (105, 6), (200, 7)]
    assert boxes.sample_table(file(struct.pack(">III", 0, 4, 9), co64)) == [(100, 4), (104, 4), (2**33, 4)]
    with pytest.raises(ValueError, match="no track"):
        boxes.sample_table(file(each, stco), b"none")


def test_walk_of_messages():
    inner = bytes([3 << 3, 150, 1])  # field 3 = 150
    data = bytes([1 << 3 | 2, len(inner)]) + inner + bytes([2 << 3 | 1]) + struct.pack("<d", 2.5) + bytes([4 << 3]) + bytes([255] * 9 + [1]) + bytes([5 << 3 | 2, 1, 65])
    assert list(records.walked(data)) == [(".1.3", 150.0), (".2", 2.5), (".4", -1.0)]
    assert list(records.walked(b"\xff")) == [] and list(records.walked(b"")) == []


def test_calibrations_of_neither_schema(spark):
    df = spark.createDataFrame([(1, "{}"), (2, None), (3, "no json"), (4, '{"pivots": []}')], "id long, text string")
    assert {r.schema for r in records.calibrations(df, ["id"], "text").collect()} == {None}


def test_tables_are_kept_by_their_parameters(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for p in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2, "b": 2}):
        assert folder.kept(spark, f"file://{tmp_path}", "t", p, make).count() == 3
    assert len(made) == 2


def test_text_sinks(spark):
    df = spark.createDataFrame([(1, 2.34567, NAN), (2, None, 1.0)], "id long, a double, b double")
    assert [tuple(r) for r in sinks.formatted(df, {"a": "%.2f"}).collect()] == [("1", "2.35", "NaN"), ("2", "", "1.0")]
    assert [r.json for r in sinks.json_rows(df, ["id"]).collect()] == ['{"a":2.34567,"b":null}', '{"a":null,"b":1.0}']
