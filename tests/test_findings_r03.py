"""What the findings of round 3 showed: long keys, half turns, wide joins."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skyplume.jobs import catalog
from skyplume.operators import images, modes, quantiles
from skyplume.sources import stations
from tests.conftest import SF, plain


def same_as_sql(spark, folder, name, **tables):
    """A query over ``tables`` written to ``folder`` gives its SQL's rows."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    a, b = plain(catalog.QUERIES[name](spark, str(folder)).toPandas()), plain(con.sql(catalog.ORACLE_SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(b)
    assert a.to_numpy().tolist() == b.to_numpy().tolist()


@pytest.mark.parametrize("name", ["hull_heights", "hull_profile", "hull_height_at_frames"])
def test_hulls_of_six_digits(spark, tmp_path, name):
    """Frames beyond 99,999 keep all their digits."""
    same_as_sql(spark, tmp_path, name, part=f"SELECT * REPLACE (CAST(p_partkey + i * 99990 AS BIGINT) AS p_partkey) FROM '{SF}/part.parquet', range(2) r(i)")


@pytest.mark.parametrize("name", ["drift_rate", "unwrap_gradient"])
def test_half_turns(spark, tmp_path, name):
    """Two decimals a half turn apart but for the last digits of doubles."""
    pairs = [(0.01, 180.01), (180.03, 0.03), (0.15, 180.15)]
    rows = ", ".join(f"({2 * k + j}, TIMESTAMP '2024-01-01' + INTERVAL ({j}) HOUR, {k}, {v}::DOUBLE)" for k, p in enumerate(pairs) for j, v in enumerate(p))
    same_as_sql(spark, tmp_path, name, events=f"SELECT CAST(a AS BIGINT) AS event_id, b AS ts, CAST(c AS BIGINT) AS user_id, d AS value FROM (VALUES {rows}) t(a, b, c, d)")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_loose_files_only_meet_stations_that_lack_them(spark):
    """The stations without files of a kind are found before any loose file is joined."""
    files = spark.createDataFrame([(f"/d/st_{i}/dir.csv", 60000, "2024-01-01") for i in range(3)] + [(f"/d/st-dir-{i}.csv", 60000, "2024-01-02") for i in range(4)], "path string, length long, modified string")
    st = spark.createDataFrame([(f"st_{i}", f"st_{i}") for i in range(4)], "id string, folder string")
    out = stations.station_files(files, st, {"dir": ".*dir.*[.]csv", "vel": ".*vel.*[.]csv"}, "d")
    got = sorted((r.id, r.path, r.origin, r.place) for r in out.collect())
    assert got == [*[(f"st_{i}", f"/d/st_{i}/dir.csv", "folder", 1) for i in range(3)], *[("st_3", f"/d/st-dir-{i}.csv", "loose", i + 1) for i in range(4)]]
    depth = {k: min(len(line) - len(line.lstrip(" :+-")) for line in plan_of(out).splitlines() if "Join" in line and k in line) for k in ("LeftAnti", "_word")}
    assert depth["LeftAnti"] > depth["_word"]


def test_pixels_of_many_frames_are_not_broadcast(spark):
    """Exploded pixels look as small as the table that they come from; only the one frame is handed to all tasks."""
    px = spark.range(40).select("id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(F.col("id").alias("frame"), F.floor(F.col("i") / 8).cast("int").alias("v"), (F.col("i") % 8).cast("int").alias("u"), ((F.col("i") * 7 + F.col("id")) % 11).cast("double").alias("value"))
    back = px.filter("frame = 3").select("v", "u", "value")
    fit = px.groupBy("frame").agg(F.lit(1.0).alias("gain"), F.lit(0.0).alias("offset"))
    for df in (images.shift(px, back, 1), images.novelty(px, back, fit)):
        held = [line for line in plan_of(df).splitlines() if "broadcast" in line]
        assert len(held) == 1 and "rightHint=(strategy=broadcast)" in held[0] and "leftHint" not in held[0]
    assert {(r.dv, r.du) for r in images.shift(px, back, 1).filter("frame = 3").collect()} == {(0, 0)}


def test_novelty_keeps_columns(spark):
    px = spark.createDataFrame([(1, 0, 0, 5.0, "a"), (1, 0, 1, 7.0, "b")], "frame int, v int, u int, value double, what string")
    back, fit = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "v int, u int, value double"), spark.createDataFrame([(1, 2.0, 1.0)], "frame int, gain double, offset double")
    assert sorted(map(tuple, images.novelty(px, back, fit, ("what",)).collect())) == [(1, 0, 0, "a", 10.0), (1, 0, 1, "b", 13.0)]


def test_files_held_in_a_table(spark):
    """Series and monthly pages as rows (path, content) read as their files do."""
    held = spark.createDataFrame([("a.csv", "FECHA;HORA;dirección\r\n240101;0000;12,5;\n240101;0100;;\n;;;\nxx\n240101;0200;7.25\n240101;0200;8;\n".encode("latin-1")), ("b.csv", b"FECHA;HORA;valor")], "path string, content binary")
    got = [(r.file, str(r.ts), r.value) for r in stations.series_of(held).orderBy("ts").collect()]
    assert [(f, t[11:16]) for f, t, _ in got] == [("a.csv", "00:00"), ("a.csv", "01:00"), ("a.csv", "02:00")] and got[0][2] == 12.5 and math.isnan(got[1][2]) and got[2][2] == 8.0
    page = b"<table><tr><th>Fecha</th><th>Hora</th><th>dd</th><th>ff (kt)</th></tr><tr><td>01-01-2024</td><td>00:00</td><td>90</td><td>10</td></tr></table>"
    got = stations.months_of(spark.createDataFrame([("e.xls", page)], "path string, content binary")).collect()
    assert [(r.file, str(r.ts), r.dir, round(r.vel, 5), r.unit) for r in got] == [("e.xls", "2024-01-01 00:00:00", 90.0, 5.14444, "knots")]


@pytest.mark.parametrize("name", ["sinca_series", "month_tables"])
def test_no_file_a_station(spark, tmp_path, monkeypatch, name):
    """Stations add no files."""
    from skyplume.jobs import reader_jobs

    monkeypatch.setattr(reader_jobs, "shared", lambda _, label: str(tmp_path / label))
    assert catalog.QUERIES[name](spark, SF).count()
    assert not [p for p in tmp_path.rglob("*") if p.suffix in (".csv", ".xls")]


def test_directions_are_shuffled_as_counts(spark):
    """Densities of a key never leave their task; two peaks by a plain search."""
    df = spark.createDataFrame([("a", float(x)) for x in [10] * 30 + [90] * 20] + [(None, 0.0), ("b", float("nan"))], "key string, angle double")
    got = {r.key: r for r in modes.density_modes(df, ["key"], F.col("angle"), least=40).collect()}
    assert got.keys() == {"a", None} and (got["a"].first, got["a"].second, got["a"].separation, got["a"].bimodal, got["a"].n) == (10.0, 90.0, 80.0, True, 50) and got["a"].height == pytest.approx(2 / 3)
    assert not got[None].bimodal and got[None].first is None
    assert "Window" not in plan_of(modes.density_modes(df, ["key"], F.col("angle"))) and "Join" not in plan_of(modes.density_modes(df, ["key"], F.col("angle")))


def test_quantiles_are_dealt_by_their_number(spark, monkeypatch):
    """More values, more tasks; the same quantiles."""
    rng = random.Random(3)
    df = spark.createDataFrame([(k % 40, rng.gauss(0, 1)) for k in range(2000)], "key int, x double")
    few = {tuple(r) for r in quantiles.quantiles(df, ["key"], F.col("x"), [0.5], ["m"]).collect()}
    monkeypatch.setattr(quantiles, "DEAL", 100)
    out = quantiles.quantiles(df, ["key"], F.col("x"), [0.5], ["m"])
    assert "RepartitionByExpression" in plan_of(out) and {tuple(r) for r in out.collect()} == few


def test_months_are_read_once(spark):
    held = spark.createDataFrame([("e_2024-01.xls", b"")], "path string, content binary")
    assert plan_of(stations.joined_months(stations.months_of(held).withColumn("k", F.lit(1)), ["k"])).count("MapInPandas") == 1


def test_polygons_of_any_shape(spark):
    """Pixels between crossings, against the even-odd rule for each pixel; corners beyond the frame, concave and crossing edges."""
    from skyplume.operators import masks

    rng = random.Random(5)
    shapes = [[[float(rng.randint(-4, 14)), float(rng.randint(-4, 12))] for _ in range(rng.randint(3, 9))] for _ in range(60)] + [[[0.0, 0.0], [3.0, 0.0]], [[20.0, 20.0], [30.0, 20.0], [30.0, 30.0]]]

    def inside(p, v, u):
        edges = [(a, b) for a, b in zip(p, p[1:] + p[:1], strict=True) if (a[1] <= v) != (b[1] <= v)]
        return sum(round(a[0] + (v - a[1]) * (b[0] - a[0]) / (b[1] - a[1]), 9) > u for a, b in edges) % 2 == 1

    want = {(k, v, u) for k, p in enumerate(shapes) if len(p) >= 3 for v in range(8) for u in range(10) if inside(p, v, u)}
    df = spark.createDataFrame(list(enumerate(shapes)), "id int, points array<array<double>>")
    out = masks.polygon_pixels(df, ["id"], "points", 8, 10)
    got = [tuple(r) for r in out.collect()]
    assert len(set(got)) == len(got) and set(got) == want
    assert "Filter" in plan_of(out) and "sequence(0, 9" not in plan_of(out)


def test_windows_are_found_in_one_pass(spark):
    from skyplume.operators import windows

    rows = spark.range(20).select(F.lit(1).alias("k"), (F.col("id") * 400).alias("ms"), F.lit(1.0).alias("angle"), F.lit(0.9).alias("texture"), F.lit(50.0).alias("edge_distance"), F.lit(0.0).alias("cut"))
    out = windows.established(rows, ["k"], "ms", 100.0)
    assert "Join" not in plan_of(out) and [(r.start, r.stop, r.degenerate) for r in out.collect()] == [(0, 7600, False)]


def test_boxes_are_shuffled_once(spark):
    """A row a box and band, keys with nulls, batches that end within a band; against the boxes unrolled."""
    from skyplume.operators import volumes

    rng = random.Random(7)
    boxes = [(rng.choice([1, 2, None]), v, v + rng.randint(-1, 5), u, u + rng.randint(-1, 4)) for v, u in ((rng.randint(-3, 20), rng.randint(-3, 11)) for _ in range(400))]
    df = spark.createDataFrame(boxes, "k int, v0 int, v1 int, u0 int, u1 int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = volumes.silhouette(df, ["k"], 20, 12, 8)
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(set(got)) == len(got) and set(got) == {(k, v, u) for k, v0, v1, u0, u1 in boxes for v in range(max(v0, 0), min(v1, 19) + 1) for u in range(max(u0, 0), min(u1, 11) + 1)}
    assert plan_of(out).count("RepartitionByExpression") == 1 and "Aggregate" not in plan_of(out)
