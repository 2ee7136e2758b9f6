"""Windows, shock fronts and refined spreads against fixtures of known truth and plain loops."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.operators import frames, refine, shock, windows

# Windows

FLOW = "clip string, ms long, angle double, texture double, edge_distance double, cut double"


def clip(name, n=60, settle=10, fades=45, nears=50, cuts=None):
    """40 turns a second until row ``settle``, texture gone from ``fades`` on, front at the border from ``nears`` on; a row each 200 ms."""
    return [(name, 200 * i, (100.0 + 8.0 * min(i, settle)) % 360, 0.8 if i < fades else 0.1, 300.0 if i < nears else 20.0, 0.0 if cuts is None or i < cuts else 0.1) for i in range(n)]


def test_windows_by_all_criteria(spark):
    rows = clip("plain") + clip("border", fades=99, nears=30) + clip("cut", fades=99, nears=99, cuts=40) + clip("open", fades=99, nears=99) + clip("never", n=20, settle=99, fades=99, nears=99) + clip("early", settle=20, fades=2, nears=99) + clip("rising") + clip("short", n=3, settle=0, fades=99, nears=99)
    hull = [(c, 200 * i, 5.0 if c == "rising" and i < 25 else 0.1, 4.0) for c in ("plain", "rising") for i in range(60)] + [("open", 0, 0.0, 4.0)]
    flow = spark.createDataFrame(rows, FLOW).repartition(4)
    got = {r.clip: r for r in windows.established(flow, ["clip"], "ms", 1080.0, spark.createDataFrame(hull, "clip string, ms long, up double, speed double"), smooth=1).collect()}
    # The turn ends where the central difference falls below 5 degrees a second, a row after the last step.
    assert got["plain"].turn_at == 2200 and got["plain"].rise_at == 0 and got["plain"].start == 2200
    assert (got["plain"].stop, got["plain"].texture_at, got["plain"].edge_at) == (9000, 9000, 10_000)
    assert (got["border"].stop, got["border"].texture_at, got["border"].edge_at) == (6000, None, 6000)
    assert got["cut"].stop == got["cut"].edge_at == 8000 and got["open"].stop == 11_800 and got["open"].edge_at is None
    assert got["open"].rise_at is None  # a single row shows nothing
    assert (got["never"].turn_at, got["never"].start, got["never"].stop) == (None, 0, 3800)
    assert got["early"].start == 4200 and got["early"].texture_at == 4200 and got["early"].degenerate and got["early"].stop == 11_800
    assert got["rising"].start == got["rising"].rise_at == 5000 and got["rising"].turn_at == 2200
    assert (got["short"].start, got["short"].stop) == (0, 400) and not got["plain"].degenerate
    # Smoothed over five rows the texture falls below its bound two rows later.
    smooth = {r.clip: r for r in windows.established(flow, ["clip"], "ms", 1080.0, smooth=5).collect()}
    assert smooth["plain"].texture_at == 9200 and smooth["plain"].rise_at is None
    assert windows.established(flow.filter(F.lit(False)), ["clip"], "ms", 1080.0).count() == 0


def test_summaries_are_weighted_by_speed(spark):
    flow = spark.createDataFrame([("a", 0, 10.0, 99.0), ("a", 1, 350.0, 1.0), ("a", 2, 20.0, 3.0), ("a", 3, 200.0, None), ("b", 0, 90.0, 2.0), ("c", 9, 1.0, 1.0)], "clip string, ms long, azimuth double, speed double")
    at = spark.createDataFrame([("a", 1, 3), ("b", 0, 0), ("c", 0, 5)], "clip string, start long, stop long")
    got = {r.clip: r for r in windows.summarised(flow, ["clip"], "ms", at).collect()}
    assert set(got) == {"a", "b"}
    s, c = (sum(w * f(math.radians(x)) for x, w in ((350, 1), (20, 3))) / 4 for f in (math.sin, math.cos))
    assert got["a"].toward == pytest.approx(math.degrees(math.atan2(s, c)) % 360) and got["a"].comes_from == pytest.approx((got["a"].toward + 180) % 360)
    assert (got["a"].n, got["a"].mean, got["a"].middle, got["a"].slowest, got["a"].fastest) == (2, 2.0, 2.0, 1.0, 3.0) and got["b"].spread == pytest.approx(0, abs=1e-4)


# Shock fronts

HEIGHT, WIDTH, FRAMES, ONSET, SPEED = 60, 80, 40, 14.3, 3.1
CENTRE = (37.0, 28.0)


def blast():
    """Noise, a few pixels that always flicker, and from ``ONSET`` on a ring that grows by ``SPEED`` pixels a frame."""
    rng = np.random.default_rng(1)
    v, u = np.indices((HEIGHT, WIDTH))
    r = np.hypot(u - CENTRE[0], v - CENTRE[1])
    clip = rng.normal(100, 0.5, (FRAMES, HEIGHT, WIDTH))
    flicker = rng.random((HEIGHT, WIDTH)) < 0.01
    clip[:, flicker] += rng.normal(0, 25, (FRAMES, int(flicker.sum())))
    for f in range(FRAMES):
        if f > ONSET:
            clip[f] += 40 * np.exp(-(((r - SPEED * (f - ONSET)) / 1.2) ** 2))
    return clip, flicker


def test_a_planted_front_gives_scale_and_zero(spark):
    clip, flicker = blast()
    f, v, u = (x.ravel() for x in np.indices(clip.shape))
    px = spark.createDataFrame(pd.DataFrame({"frame": f, "v": v, "u": u, "value": clip.ravel()})).repartition(6).persist()
    floors = shock.noise_floors(px.filter("frame < 12"), WIDTH)
    own = clip[:12].std(axis=0) * 2.5
    strip = np.arange(WIDTH) * 8 // WIDTH
    want = np.minimum(own, np.array([np.percentile(own[:, strip == s], 50) for s in range(8)])[strip][None, :])
    assert all(r.floor == pytest.approx(want[r.v, r.u]) for r in floors.collect())

    found = shock.pulses(px, floors, 5.0 / 15, rows=40_000).persist()
    fast = np.abs(frames.passed_high(clip, 5.0 / 15))
    high = np.ones((FRAMES - 4, HEIGHT, WIDTH), bool)
    for d in (-2, -1, 1, 2):
        high &= fast[2:-2] > fast[2 + d : FRAMES - 2 + d]
    high &= fast[2:-2] > want
    assert {(r.frame, r.v, r.u): pytest.approx(r.strength, abs=1e-9) for r in found.collect()} == {(t + 2, a, b): fast[t + 2, a, b] for t, a, b in zip(*map(np.ndarray.tolist, np.nonzero(high)), strict=True)}

    wide = shock.widened(found, HEIGHT, WIDTH).persist()
    odd = {(r.v, r.u) for r in shock.chronic(wide, list(range(2, 12)), 8.0, 0.15).collect()}
    assert odd and all(flicker[max(0, a - 1) : a + 2, max(0, b - 1) : b + 2].any() for a, b in odd)  # only by pixels that flicker
    ring = shock.fronts(found, CENTRE, HEIGHT, WIDTH, 8.0, 60, 3.0, 8, spark.createDataFrame(sorted(odd), "v int, u int"))
    radii = {r.frame: r.radius for r in ring.collect()}
    true = {f: SPEED * (f - ONSET) for f in range(17, 22)}
    assert all(radii[f] == pytest.approx(r, abs=1.0) for f, r in true.items())
    line = shock.front_line(ring.filter("frame between 17 and 22").withColumn("first", F.lit(17)), [], "first", 30.0, 340.3).first()
    assert line.slope == pytest.approx(SPEED, rel=0.05) and line.zero_frame == pytest.approx(ONSET, abs=0.35) and line.r2 > 0.99
    assert line.pixels_per_metre == pytest.approx(line.slope * 30 / 340.3)


def test_short_clips_and_lines_that_do_not_grow(spark):
    px = spark.createDataFrame([(f, 0, 0, float(f)) for f in range(4)], "frame long, v int, u int, value double")
    assert shock.pulses(px, px.select("v", "u", F.lit(0.0).alias("floor")), 0.3).count() == 0
    points = spark.createDataFrame([("two", 0, 1, 1.0, 0.0), ("two", 1, 1, 2.0, 0.0), ("two", 2, 1, 9.0, 0.0), ("back", 0, 1, 0.0, 0.0), ("back", 1, 1, 9.0, 0.0), ("back", 2, 1, 5.0, 0.0), ("back", 3, 1, 1.0, 0.0), ("good", 5, 1, 3.0, 4.0), ("good", 5, 2, 99.0, 99.0), ("good", 6, 1, 9.0, 12.0), ("good", 7, 1, 15.0, 20.0), ("good", 8, 1, 3.0, 34.0)], "key string, frame long, place int, x double, y double")
    rows = shock.front_line(shock.clicked(points, ["key"]), ["key"], "reference", 10.0, 100.0).collect()
    assert [r.key for r in rows] == ["good"]  # two points are too few, and a radius that shrinks is none
    assert (rows[0].slope, rows[0].intercept, rows[0].zero_frame, rows[0].r2, rows[0].pixels_per_metre) == pytest.approx((10, 0, 5, 1, 1))


# Refinement


def test_refinement_is_the_plain_loop(spark):
    camera = Camera.at(1400.0, (500.0, 400.0, 1000.0), 45.0, -50.0, 1920, 1080)
    rng = np.random.default_rng(2)
    rows = [(c, k, float(a), float(b), float(d), float(e), float(n), 80.0, float(h), float(q)) for c in ("x", "y", "z") for k, (a, b, d, e, n, h, q) in enumerate(zip(rng.uniform(50, 400, 9), rng.uniform(50, 400, 9), rng.uniform(-20, 20, 9), rng.uniform(0, 900, 9), rng.uniform(0, 900, 9), rng.uniform(5, 60, 9), rng.uniform(0.0, 0.9 if c != "z" else 1e-6, 9), strict=True))]
    df = spark.createDataFrame(rows, "clip string, row int, see double, snn double, sen double, east double, north double, z double, up double, ratio double")
    got = {(r.clip, r.row): r for r in refine.refined(refine.on_right_plane(df, camera, 20.0, "z", "up"), ["clip"], camera, 70.0, "ratio", 6).collect()}
    tangent, phi = math.tan(math.radians(40)), math.radians(25)
    for name in "xyz":
        mine = [r for r in rows if r[0] == name]
        f = [(980 - r[8]) / (980 - 60) for r in mine]
        spread = lambda r, f, az: math.sqrt(f * f * (math.sin(az) ** 2 * r[2] + 2 * math.sin(az) * math.cos(az) * r[4] + math.cos(az) ** 2 * r[3]))
        al, cr = ([spread(r, k, math.radians(a)) for r, k in zip(mine, f, strict=True)] for a in (70, 160))
        z, rounds = [r[9] * c for r, c in zip(mine, cr, strict=True)], 0
        while True:
            rounds += 1
            across = [math.sqrt(max(c * c - (s * tangent * math.sin(phi)) ** 2, 1e-6)) for c, s in zip(cr, z, strict=True)]
            along = [math.sqrt(max(c * c - (s * tangent * math.cos(phi)) ** 2, 1e-6)) for c, s in zip(al, z, strict=True)]
            new = [r[9] * c for r, c in zip(mine, across, strict=True)]
            change, z = max(abs(a - b) for a, b in zip(new, z, strict=True)), new
            if change < 1e-4 or rounds == 6:
                break
        for k, r in enumerate(mine):
            g = got[name, r[1]]
            assert (g.along, g.across, g.vertical, g.change) == pytest.approx((along[k], across[k], z[k], change)) and g.rounds == rounds
            assert (g.factor, g.east, g.north, g.z) == pytest.approx((f[k], 500 + f[k] * (r[5] - 500), 400 + f[k] * (r[6] - 400), 20 + r[8]))
    assert got["z", 0].rounds < got["x", 0].rounds


def test_a_camera_overhead_adds_nothing():
    tangent, along, across = refine.sight(Camera.at(100.0, (0.0, 0.0, 9.0), 30.0, -90.0, 10, 10), 75.0)
    assert tangent == pytest.approx(0, abs=1e-7)
    tangent, along, across = refine.sight(Camera.at(100.0, (0.0, 0.0, 9.0), 30.0, -45.0, 10, 10), 30.0)
    assert (tangent, along, across) == pytest.approx((1, 1, 0), abs=1e-9)


# Streams


def test_sessions_as_a_stream_with_late_rows(spark, tmp_path):
    """Files that arrive one by one: sessions come out once the watermark has passed them, a row that is late but within it counts, one beyond it is dropped."""
    from skyplume.streaming.episodes import session_counts

    at = lambda minutes: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)
    files = [[(1, at(0), 1.0), (1, at(20), 2.0), (2, at(5), 7.0)], [(1, at(40), 4.0), (2, at(300), 1.0)], [(1, at(130), 8.0), (3, at(290), 2.0)], [(4, at(900), 1.0), (2, at(10), 99.0)], [(4, at(2000), 1.0)]]
    schema = "user_id long, ts timestamp, value double"
    for k, rows in enumerate(files):
        frame = pd.DataFrame(rows, columns=["user_id", "ts", "value"])
        spark.createDataFrame(frame, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = session_counts(stream, "30 minutes", "200 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.user_id, r.n, r.total, (r.end_us - r.start_us) // 60_000_000) for r in spark.table("sessions").collect())
    # 1: 0, 20 and 40 are one session, 130 (late, within 200 minutes of 300) another; 2: 10 is 290 minutes late.
    assert got == [(1, 1, 8.0, 30), (1, 3, 7.0, 70), (2, 1, 1.0, 30), (2, 1, 7.0, 30), (3, 1, 2.0, 30), (4, 1, 1.0, 30)]
    spark.sql("drop view sessions")


# Fields and series


def test_density_fields(spark):
    from skyplume.operators import volumes

    rng = np.random.default_rng(8)
    shape = (9, 8, 12)
    solids = {1: {tuple(map(int, c)) for c in np.argwhere(rng.random(shape) < 0.05)}, 2: {(4, 4, 5)}, 3: {(0, 0, 0)}}
    df = spark.createDataFrame([(f, *c) for f, s in solids.items() for c in s] + [(2, 99, 0, 0)], "frame long, v int, u int, k int")
    got = {}
    for r in volumes.density_fields(df, shape, 0.8, 0.09).collect():
        got.setdefault(r.frame, {})[r.v, r.u, r.k] = r.density
    mirror = lambda i, n: i if 0 <= i < n else (-1 - i if i < 0 else 2 * n - 1 - i)
    w = np.exp(-(np.arange(-3, 4) ** 2) / (2 * 0.64))
    w /= w.sum()
    for f, solid in solids.items():
        a = np.zeros(shape)
        for c in solid:
            a[c] = 1
        for axis, n in enumerate(shape):
            a = sum(w[d + 3] * np.take(a, [mirror(i + d, n) for i in range(n)], axis=axis) for d in range(-3, 4))
        a *= 0.09 / a.max()
        assert got[f] == {tuple(map(int, c)): pytest.approx(a[tuple(c)]) for c in np.argwhere(a >= 1e-6)}
    assert {tuple(r)[1:] for r in volumes.density_fields(df.filter("frame = 2"), shape, 0.0).collect()} == {(4, 4, 5, 0.09)}


def test_gas_outside_the_grid(spark):
    from skyplume.operators import volumes

    gas = spark.createDataFrame([(1, 0, k) for k in range(10)] + [(2, 0, 1)], "frame long, v int, u int")
    seen = spark.createDataFrame([(0, 1), (0, 1), (0, 2)], "v int, u int")
    assert {r.frame: r.share for r in volumes.outside_grid(gas, seen, 5, 20, 2).collect()} == {1: 0.5, 2: 0.0}
