"""GeoTIFF files, glTF hulls, silhouettes and cleaned volumes against what is known of them."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

from skyplume.functions.camera import Camera
from skyplume.operators import volumes
from skyplume.operators.rasters import Grid
from skyplume.sinks import geotiff as tiff_sink
from skyplume.sinks import meshes as mesh_sink
from skyplume.sources import files, geotiff, meshes

# GeoTIFF


def packed_codes(data: bytes) -> bytes:
    """LZW as TIFF writers do it."""
    bits, n, out = 0, 0, bytearray()

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
            bits &= (1 << n) - 1

    fresh = lambda: {bytes([k]): k for k in range(256)}
    table, width, held = fresh(), 9, b""
    put(256, width)
    for k in range(len(data)):
        c = data[k : k + 1]
        if held + c in table:
            held += c
            continue
        put(table[held], width)
        table[held + c] = len(table) + 2
        held = c
        size = len(table) + 2
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            put(table[held], width)  # what is held, before the table is cleared
            put(256, width)
            table, width, held = fresh(), 9, b""
    if held:
        put(table[held], width)
        size = len(table) + 3
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257, width)
    if n:
        out.append(bits << 8 - n & 255)
    return bytes(out)


def tiff(z, kind="<f4", big=False, block=None, compression=1, predictor=1, bands=1, nodata=None, place=None, model=1, raster=1, skip=()):
    """A file's bytes; ``block`` (rows, columns) makes tiles, a number strips."""
    order, z = kind[0], np.asarray(z).astype(kind)
    height, width = z.shape
    tiled = isinstance(block, tuple)
    high, wide = block if tiled else (block or height, width)
    raws = []
    for r in range(0, height, high):
        for c in range(0, width, wide):
            part = z[r : r + high, c : c + wide]
            if tiled:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1])))
            part = np.repeat(part[:, :, None], bands, axis=2)
            part[:, :, 1:] += np.array(7, kind)  # bands beyond the first differ
            if predictor == 2:
                flat = part.astype(part.dtype.newbyteorder("=")).view(f"u{z.itemsize}")
                part = np.diff(flat, axis=1, prepend=np.zeros_like(flat[:, :1])).astype(f"{order}u{z.itemsize}")
            raw = part.tobytes()
            if predictor == 3:
                split = part.astype(part.dtype.newbyteorder(">")).view(np.uint8).reshape(part.shape[0], part.shape[1] * bands, -1).transpose(0, 2, 1).reshape(part.shape[0], -1, bands)
                raw = np.diff(split, axis=1, prepend=np.zeros_like(split[:, :1])).tobytes()
            raws.append(b"" if len(raws) in skip else {1: bytes, 5: packed_codes, 8: zlib.compress, 32946: zlib.compress}[compression](raw))
    keys = (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, raster, 3072, 0, 1, 32719)
    tags = {256: ("I", (width,)), 257: ("I", (height,)), 258: ("H", (8 * z.itemsize,) * bands), 259: ("H", (compression,)), 277: ("H", (bands,)), 317: ("H", (predictor,)), 339: ("H", ({"u": 1, "i": 2, "f": 3}[kind[1]],) * bands), 34735: ("H", keys)}
    tags |= {322: ("H", (wide,)), 323: ("H", (high,))} if tiled else {278: ("I", (high,))}
    tags |= place or {33550: ("d", (2.0, 2.0, 0.0)), 33922: ("d", (0.0, 0.0, 0.0, 500.0, 900.0, 0.0))}
    if nodata is not None:
        tags[42113] = ("s", (nodata.encode() + b"\0",))
    offsets, counts = (324, 325) if tiled else (273, 279)
    wide_kind = "Q" if big else "I"
    tags[offsets], tags[counts] = (wide_kind, (0,) * len(raws)), (wide_kind, tuple(map(len, raws)))
    pack = lambda k, v: v[0] if k == "s" else struct.pack(f"{order}{len(v)}{k}", *v)
    code, room = {"s": 2, "H": 3, "I": 4, "d": 12, "Q": 16}, 8 if big else 4
    start = (16 + 8 + 20 * len(tags) + 8) if big else (8 + 2 + 12 * len(tags) + 4)
    at = start + sum(len(x) for x in (pack(*v) for v in tags.values()) if len(x) > room)
    places = []
    for raw in raws:
        places.append(at if raw else 0)
        at += len(raw)
    tags[offsets] = (wide_kind, tuple(places))
    entries, body = b"", b""
    for tag in sorted(tags):
        raw = pack(*tags[tag])
        here = struct.pack(f"{order}{wide_kind}", start + len(body)) if len(raw) > room else raw.ljust(room, b"\0")
        body += raw if len(raw) > room else b""
        entries += struct.pack(f"{order}HH{wide_kind}", tag, code[tags[tag][0]], len(raw) if tags[tag][0] == "s" else len(tags[tag][1])) + here
    mark = b"II" if order == "<" else b"MM"
    head = struct.pack(f"{order}HHHQ", 43, 8, 0, 16) + struct.pack(f"{order}Q", len(tags)) if big else struct.pack(f"{order}HI", 42, 8) + struct.pack(f"{order}H", len(tags))
    return mark + head + entries + struct.pack(f"{order}{wide_kind}", 0) + body + b"".join(raws)


def grid_of(cells):
    """Rows (col, row, z) as an array."""
    out = {(r.row, r.col): r.z for r in cells}
    high, wide = max(k[0] for k in out) + 1, max(k[1] for k in out) + 1
    return [[out[i, j] for j in range(wide)] for i in range(high)]


FORMS = [
    {}, {"kind": ">f4", "block": 3}, {"kind": "<i2", "block": (16, 16), "compression": 8, "predictor": 2}, {"kind": ">u2", "block": 4, "compression": 5, "predictor": 2}, {"kind": "<f8", "big": True, "block": (16, 32), "compression": 5},
    {"kind": "<f4", "block": (16, 16), "compression": 8, "predictor": 3}, {"kind": ">f8", "block": 5, "compression": 32946, "predictor": 3, "bands": 2}, {"kind": "<u1", "bands": 3, "block": 2, "compression": 5}, {"kind": ">i4", "big": True, "compression": 8},
]


@pytest.mark.parametrize("form", FORMS, ids=[str(k) for k in range(len(FORMS))])
def test_geotiff_forms(spark, tmp_path, form):
    z = np.random.default_rng(1).integers(0, 120, (37, 45))
    z[5, 7] = 99
    (tmp_path / "a.tif").write_bytes(tiff(z, nodata="99", **form))
    (tmp_path / "note.txt").write_text("not a raster")
    rows = geotiff.read_geotiff(spark, str(tmp_path)).collect()
    assert grid_of(rows) == [[None if v == 99 else float(v) for v in line] for line in z]
    assert all(r.x == 501 + 2 * r.col and r.y == 899 - 2 * r.row and r.file.endswith("/a.tif") for r in rows)


def test_lzw_of_long_blocks():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"aaaa" * 4000, rng.integers(0, 256, 20_000).astype(np.uint8).tobytes(), rng.integers(0, 3, 30_000).astype(np.uint8).tobytes()):
        assert geotiff.expanded(packed_codes(data)) == data


def test_geotiff_window_is_rounded_outwards(spark, tmp_path):
    z = np.arange(30 * 40).reshape(30, 40)
    (tmp_path / "a.tif").write_bytes(tiff(z, block=(16, 16)))
    # 500 + 2 * col: 507 lies in column 3; 10.5 cells wide make 11; 855 lies 22.5 rows down.
    rows = geotiff.read_geotiff(spark, str(tmp_path / "a.tif"), (507.0, 850.0, 528.0, 855.0)).collect()
    assert {(r.col, r.row) for r in rows} == {(c, r) for c in range(3, 14) for r in range(22, 25)}
    cells = geotiff.as_grid(geotiff.read_geotiff(spark, str(tmp_path), (490.0, 890.0, 504.0, 1000.0)))
    assert {(r.ix, r.iy, r.x, r.y, r.z) for r in cells.collect()} == {(c, 4 - r, 501.0 + 2 * c, 899.0 - 2 * r, float(z[r, c])) for c in range(2) for r in range(5)}
    assert geotiff.read_geotiff(spark, str(tmp_path), (0.0, 0.0, 10.0, 10.0)).count() == 0


def test_only_wanted_blocks_are_decoded(spark, tmp_path, monkeypatch):
    z = np.arange(64 * 96).reshape(64, 96)
    path = tmp_path / "a.tif"
    path.write_bytes(tiff(z, block=(16, 16), compression=8))
    seen = []
    decode = geotiff.block_cells
    monkeypatch.setattr(geotiff, "block_cells", lambda raster, data, rows: seen.append(rows) or decode(raster, data, rows))
    reader = geotiff.GeoTiffReader(str(path), None)
    wanted = [GreaterThanOrEqual(("x",), 500 + 2 * 33.0), LessThan(("x",), 500 + 2 * 47.0), GreaterThan(("row",), 20), EqualTo(("col",), 40), LessThan(("z",), 1.0), EqualTo(("file",), "x")]
    assert list(reader.pushFilters(wanted)) == wanted  # Spark checks them all again
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert len(seen) == 3 and rows == 3 * 256  # of 24
    # The plan hands the comparisons on, and the result is that of a filter.
    cells = geotiff.read_geotiff(spark, str(path)).filter("x between 566 and 594 and row > 20 and z % 2 = 0")
    assert {(r.col, r.row) for r in cells.collect()} == {(c, r) for c in range(33, 47) for r in range(21, 64) if z[r, c] % 2 == 0}


def test_files_are_dealt_out(tmp_path, monkeypatch):
    z = np.arange(64 * 96).reshape(64, 96)
    (tmp_path / "a.tif").write_bytes(tiff(z, block=(16, 16), skip=(3,)))
    monkeypatch.setattr(geotiff, "SHARE", 5000)
    reader = geotiff.GeoTiffReader(str(tmp_path), None)
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) == 5 and len(rows) == z.size == len({(r["col"], r["row"]) for r in rows})
    assert all(r["z"] == (None if r["row"] < 16 and 48 <= r["col"] < 64 else z[r["row"], r["col"]]) for r in rows)


def test_places(tmp_path):
    def corner(**form):
        path = tmp_path / "a.tif"
        path.write_bytes(tiff(np.zeros((4, 5)), **form))
        with files.opened(str(path)) as source:
            r = geotiff.described(source)
        return r.corner, r.step, r.system

    assert corner() == ((500.0, 900.0), (2.0, -2.0), 32719)
    assert corner(raster=2) == ((499.0, 901.0), (2.0, -2.0), 32719)
    assert corner(place={33550: ("d", (3.0, 4.0, 0.0)), 33922: ("d", (2.0, 1.0, 0.0, 500.0, 900.0, 0.0))})[:2] == ((494.0, 904.0), (3.0, -4.0))
    turned = lambda b: {34264: ("d", (2.0, b, 0.0, 500.0, 0.0, -2.0, 0.0, 900.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))}
    assert corner(place=turned(0.0))[:2] == ((500.0, 900.0), (2.0, -2.0))
    for form, what in (({"place": turned(0.1)}, "rotated"), ({"model": 2}, "projected"), ({"place": {270: ("s", (b"no place\0",))}}, "no place")):
        with pytest.raises(ValueError, match=what):
            corner(**form)
    (tmp_path / "b.tif").write_bytes(b"not a raster at all")
    with pytest.raises(ValueError, match="TIFF"), files.opened(str(tmp_path / "b.tif")) as source:
        geotiff.described(source)


def test_wrong_files_fail_in_spark(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(np.zeros((4, 5)), model=2))
    with pytest.raises(Exception, match="projected"):
        geotiff.read_geotiff(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="missing"):
        geotiff.read_geotiff(spark, str(tmp_path / "missing")).collect()


@pytest.mark.parametrize("predictor", [1, 3])
def test_raster_sink_round_trip(spark, tmp_path, predictor):
    z = np.random.default_rng(3).normal(size=(70, 130)).astype(np.float32)
    z[3, 4] = np.nan
    (tmp_path / "a.tif").write_bytes(tiff_sink.encoded(z, 1000.0, 3000.0, 2.5, 32719, predictor=predictor))
    rows = geotiff.read_geotiff(spark, str(tmp_path)).collect()
    assert grid_of(rows) == [[None if math.isnan(v) else float(v) for v in line] for line in z]
    assert (rows[0].x, rows[0].y) == (1001.25, 2998.75)


def test_named_files(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    files.write_files(spark.createDataFrame([(f"f{k}", bytes([k])) for k in range(20)], "name string, content binary").repartition(5), folder)
    files.write_files(spark.createDataFrame([("f3", b"new"), ("g", b"")], "name string, content binary"), folder)
    got = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert got == {f"f{k}": bytes([k]) for k in range(20)} | {"f3": b"new", "g": b""}
    for bad in ([("a", b"x"), ("a", b"y")], [("../a", b"x")], [("", b"x")]):
        with pytest.raises(Exception, match=r"name"):
            files.write_files(spark.createDataFrame(bad, "name string, content binary"), folder)
    # A task that was still writing may leave its hidden folder, and no file elsewhere.
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name[0] != "_"} == set(got)


def test_raster_files_from_cells(spark, tmp_path):
    grid = Grid(10.0, 20.0, 2.0, 5, 4)
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 4, 3, 2.0), ("b", 2, 1, float("nan"))], "raster string, ix int, iy int, z double")
    files.write_files(tiff_sink.rasters(cells, "raster", grid, 32719), str(tmp_path / "r"))
    rows = geotiff.as_grid(geotiff.read_geotiff(spark, str(tmp_path / "r"))).collect()
    assert {(r.file[-5], r.ix, r.iy, r.x, r.y, r.z) for r in rows if r.z is not None} == {("a", 0, 0, 10.0, 20.0, 1.0), ("a", 4, 3, 18.0, 26.0, 2.0)}
    assert len(rows) == 40


# Hulls

CUBE = (np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)], float), np.array([(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]))


def ball(n=24):
    """A closed surface of rings and two poles."""
    a, b = np.meshgrid(np.arange(1, n) * math.pi / n, np.arange(2 * n) * math.pi / n, indexing="ij")
    rings = np.stack([np.sin(a) * np.cos(b), np.sin(a) * np.sin(b), np.cos(a)], axis=-1).reshape(-1, 3)
    points, m = np.concatenate([rings, [(0, 0, 1), (0, 0, -1)]]), 2 * n
    at = lambda i, j: i * m + j % m
    faces = [f for i in range(n - 2) for j in range(m) for f in ((at(i, j), at(i + 1, j), at(i + 1, j + 1)), (at(i, j), at(i + 1, j + 1), at(i, j + 1)))]
    faces += [f for j in range(m) for f in ((len(rings), at(0, j), at(0, j + 1)), (len(rings) + 1, at(n - 2, j + 1), at(n - 2, j)))]
    return points, np.array(faces)


def test_moments_of_solids():
    points, faces = CUBE
    v, c, s = meshes.solid_moments(points * (2, 3, 4) + (7, 8, 9), faces)
    assert v == pytest.approx(24) and c == pytest.approx([8, 9.5, 11]) and s == pytest.approx(np.diag([4, 9, 16]) / 12, abs=1e-12)
    # Far away, sheared: the covariance follows the map.
    shear = np.array([[1, 0.5, 0], [0, 1, 0], [0.2, 0, 2]])
    v, c, s = meshes.solid_moments(points @ shear.T + 1e6, faces)
    assert v == pytest.approx(2, rel=1e-9) and s == pytest.approx(shear @ shear.T / 12, abs=1e-8)
    points, faces = ball(48)
    v, c, s = meshes.solid_moments(points * 5, faces)
    assert v == pytest.approx(4 / 3 * math.pi * 125, rel=5e-3) and c == pytest.approx([0, 0, 0], abs=1e-9) and np.diag(s) == pytest.approx([5] * 3, rel=5e-3)
    assert meshes.solid_moments(points, faces[:, ::-1])[0] < 0


def test_closed_surfaces():
    points, faces = CUBE
    assert meshes.closed(faces) and meshes.closed(ball()[1]) and meshes.closed(faces[:, ::-1])
    turned = faces.copy()
    turned[0] = turned[0][::-1]
    for bad in (faces[:-1], turned, np.concatenate([faces, faces[:1]]), faces[:0], np.array([(0, 0, 1)])):
        assert not meshes.closed(bad)


def glb(views, accessors, primitives, body, name="hull_f00007"):
    head = json.dumps({"asset": {"version": "2.0"}, "meshes": [{"name": name, "primitives": primitives}], "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(body)}]}).encode()
    head += b" " * (-len(head) % 4)
    return struct.pack("<III", 0x46546C67, 2, 28 + len(head) + len(body)) + struct.pack("<II", len(head), 0x4E4F534A) + head + struct.pack("<II", len(body), 0x004E4942) + body


def test_strides_kinds_and_parts():
    points, faces = CUBE
    # Positions interleaved with four other bytes, indices of 16 bits, the surface in two parts and one of lines.
    mixed = b"".join(p.astype("<f4").tobytes() + b"\xff" * 4 for p in points)
    index = faces.astype("<u2").tobytes()
    views = [{"buffer": 0, "byteOffset": 0, "byteLength": len(mixed), "byteStride": 16}, {"buffer": 0, "byteOffset": len(mixed), "byteLength": len(index)}]
    accessors = [{"bufferView": 0, "componentType": 5126, "count": 8, "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": 18, "type": "SCALAR"}, {"bufferView": 1, "byteOffset": 36, "componentType": 5123, "count": 18, "type": "SCALAR"}]
    parts = [{"attributes": {"POSITION": 0}, "indices": 1}, {"attributes": {"POSITION": 0}, "indices": 2}, {"attributes": {"POSITION": 0}, "mode": 1}]
    [(name, p, f)] = meshes.meshes(glb(views, accessors, parts, mixed + index))
    assert name == "hull_f00007" and len(p) == 8 and len(f) == 12 and meshes.closed(f) and meshes.solid_moments(p, f)[0] == pytest.approx(1)
    accessors[1]["count"] = 3000
    with pytest.raises(ValueError, match="beyond"):
        list(meshes.meshes(glb(views, accessors, parts, mixed + index)))
    for bad in (b"", b"glTF", b"\0" * 40, glb(views, accessors, parts, mixed + index)[:60]):
        with pytest.raises(ValueError, match="glTF|chunk|description"):
            list(meshes.meshes(bad))


def test_hulls_from_files(spark, tmp_path):
    points, faces = ball()
    parts = [("hull_f00003", points * 4 + (10, 20, 30), faces), ("f5_open", points * 2, faces[1:]), ("floor", points, faces), ("x9y8", points[:, ::1] * (3, 1, 2), faces[:, ::-1])]
    (tmp_path / "a.glb").write_bytes(mesh_sink.encoded(parts))
    (tmp_path / "note.txt").write_text("no mesh")
    rows = {r.mesh: r for r in meshes.read_meshes(spark, str(tmp_path)).collect()}
    a, b, c, d = (rows[n] for n, *_ in parts)
    assert (a.frame, a.closed, b.frame, b.closed, c.frame, d.frame, d.closed) == (3, True, 5, False, None, 9, True)
    assert (a.east, a.north, a.up, a.top) == pytest.approx((10, 20, 30, 34), abs=1e-4) and a.volume == pytest.approx(64 * c.volume, rel=1e-5)
    assert b.volume is None and (b.east, b.north, b.up) == pytest.approx((0, 0, 0), abs=1e-5) and d.volume == pytest.approx(6 * c.volume, rel=1e-5)
    assert (d.see, d.snn, d.suu) == pytest.approx((9 * c.see, c.see, 4 * c.suu), rel=1e-3)
    profile = {r.frame: r for r in meshes.hull_profile(meshes.read_meshes(spark, str(tmp_path)), "file", 90.0, fps=2.0, first_frame=1.0).collect()}
    assert set(profile) == {3, 9} and profile[9].t == 4.0 and profile[9].azimuth == pytest.approx(90) and profile[9].along == pytest.approx(3 * profile[9].across, rel=1e-3) and profile[9].resolved
    with pytest.raises(Exception, match="glTF"):
        meshes.meshes_of(spark.createDataFrame([("a", b"nothing of the kind")], "file string, content binary"), "file", "content").collect()


def test_confidence_follows_the_series(spark):
    hulls = spark.createDataFrame([(f, k, 1.0, 2.0, 3.0, 4.0) for f in "ab" for k in (1, 2, 3)], "file string, frame long, east double, north double, up double, top double")
    series = spark.createDataFrame([("a", 1, "strict"), ("a", 2, "no shadow"), ("b", 1, "no shadow"), ("b", 2, "no shadow"), ("c", 1, "strict")], "file string, frame long, mode string")
    got = {(r.file, r.frame): r.confident for r in meshes.hull_heights(hulls, "file", 10.0, series).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): False, ("b", 1): True, ("b", 2): True, ("b", 3): True}  # none of b's: all
    assert all(r.confident and r.z == 13.0 for r in meshes.hull_heights(hulls, "file", 10.0).collect())


def test_heights_at_frames(spark):
    heights = spark.createDataFrame([("a", 10, 5.0, True), ("a", 20, 9.0, True), ("a", 15, 99.0, False), ("b", 1, 1.0, False)], "file string, frame long, z double, confident boolean")
    frames = spark.createDataFrame([("a", k) for k in (1, 10, 12, 20, 31)] + [("b", 1)], "file string, frame long")
    got = {(r.file, r.frame): r.z for r in meshes.last_confident(frames, heights, "file").collect()}
    assert got == {("a", 1): 5.0, ("a", 10): 5.0, ("a", 12): 5.8, ("a", 20): 9.0, ("a", 31): 9.0, ("b", 1): None}


# Silhouettes


@pytest.mark.parametrize("band", [4, 7, 256])
def test_difference_array_is_the_boxes_unrolled(spark, band):
    rng = np.random.default_rng(4)
    rows = [(int(k) % 3, *(int(x) for x in (v, u, v + a, u + b))) for k, v, u, a, b in zip(range(90), rng.integers(-6, 32, 90), rng.integers(-6, 45, 90), rng.integers(-1, 9, 90), rng.integers(-1, 9, 90), strict=True)]
    rows += [(7, 0, 0, 29, 39), (8, 5, 5, None, 9), (9, -9, -9, -1, -1)]
    want = {(f, v, u) for f, v0, u0, v1, u1 in rows if v1 is not None for v in range(max(v0, 0), min(v1, 29) + 1) for u in range(max(u0, 0), min(u1, 39) + 1)}
    boxes = spark.createDataFrame(rows, "frame int, v0 int, u0 int, v1 int, u1 int")
    got = volumes.silhouette(boxes, ["frame"], 30, 40, band).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    runs = volumes.covered_runs(boxes, ["frame"], 30, 40, band).collect()
    assert all((r.frame, r.v, r.u0 - 1) not in want and (r.frame, r.v, r.u1 + 1) not in want for r in runs)


def test_cost_of_boxes_does_not_follow_their_area(spark):
    """However large the boxes, what is shuffled are four corners for each box and band."""
    large = spark.createDataFrame([(1, k, k, 4000 - k, 6000 - k) for k in range(200)], "frame int, v0 int, u0 int, v1 int, u1 int")
    runs = volumes.covered_runs(large, ["frame"], 4096, 8192).collect()
    assert sum(r.u1 - r.u0 + 1 for r in runs) == 4001 * 6001


def test_voxels_before_the_camera(spark):
    camera = Camera.at(100.0, (0.0, 0.0, 0.0), 0.0, 0.0, 40, 30)
    voxels = spark.createDataFrame([(1, 0.0, 10.0, 0.0), (1, 0.0, -10.0, 0.0), (1, 0.0, 0.4, 0.0), (1, 90.0, 10.0, 0.0)], "frame int, x double, y double, z double")
    got = volumes.voxel_boxes(voxels, ["frame"], camera, "x", "y", "z", 1.0).collect()
    # The nearer face is 9.5 away: half an edge is 5.26 pixels; what is not ahead is left out, what is beside is cut.
    assert sorted(map(tuple, got)) == [(1, 9, 14, 21, 26), (1, 9, 39, 21, 39)]


# Volumes

SIX = [(0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]


def brute_clean(cells, shape, close, open_, largest, least):
    inside = lambda c: all(0 <= x < n for x, n in zip(c, shape, strict=True))
    near = lambda c: [tuple(x + d for x, d in zip(c, s, strict=True)) for s in SIX]
    grow = lambda s: s | {n for c in s for n in near(c) if inside(n)}
    shrink = lambda s: {c for c in s if all(n in s for n in near(c))}

    def times(f, s, n):
        for _ in range(n):
            s = f(s)
        return s

    before = len(cells)
    cells = times(shrink, times(grow, cells, close), close)
    opened = False
    if open_ and before >= least and (smaller := times(grow, times(shrink, cells, open_), open_)):
        cells, opened = smaller, True
    parts, left = [], set(cells)
    while left and largest:
        seed = min(left)
        left.discard(seed)
        part, wait = {seed}, deque([seed])
        while wait:
            for n in near(wait.popleft()):
                if n in left:
                    left.discard(n)
                    part.add(n)
                    wait.append(n)
        parts.append(part)
    kept = max(parts, key=lambda p: (len(p), [-x for x in min(p)])) if parts else cells
    return kept, len(parts), opened


@pytest.mark.parametrize("how", [{}, {"close": 2, "open_": 2}, {"close": 0}, {"open_": 0}, {"largest": False}, {"least_open": 30}])
def test_cleaned_volumes(spark, how):
    rng = np.random.default_rng(5)
    shape = (9, 8, 7)
    frames = {0: {(0, 0, 0)}, 1: {(4, 4, 4)}, 2: {(k, j, i) for k in range(9) for j in range(8) for i in range(7)}, 3: {(1, 1, 1), (5, 5, 5)}, 4: {(x, y, z) for x in range(1, 4) for y in range(1, 4) for z in range(1, 4)} | {(x, y, z) for x in range(5, 8) for y in range(4, 7) for z in range(2, 5)}}
    for f in range(5, 15):
        frames[f] = {tuple(map(int, c)) for c in np.argwhere(rng.random(shape) < rng.uniform(0.1, 0.7))}
    rows = [(f, *c) for f, s in frames.items() for c in s] + [(1, 4, 4, 4), (1, 9, 0, 0), (1, -1, 0, 0), (20, 9, 9, 9)]
    voxels = spark.createDataFrame(rows, "frame long, v int, u int, k int")
    got = {r.frame: r for r in volumes.cleaned_frames(voxels, shape, **{"least_open": 60, **how}).collect()}
    assert set(got) == set(frames)
    for f, s in frames.items():
        kept, parts, opened = brute_clean(s, shape, how.get("close", 1), how.get("open_", 1), how.get("largest", True), how.get("least_open", 60))
        r = got[f]
        assert ({tuple(c) for c in r.cells}, r.n_components, r.opened, r.n_before, r.n_after) == (kept, parts, opened, len(s), len(kept)), f
    domain = spark.createDataFrame([(k, j, i) for k in range(9) for j in range(8) for i in range(7) if (k + j + i) % 2], "v int, u int, k int")
    assert {(r.frame, r.v, r.u, r.k) for r in volumes.regularized(voxels, shape, domain, **{"least_open": 60, **how}).collect()} == {(f, *c) for f, r in got.items() for c in r.cells if sum(c) % 2}
    assert volumes.cleaned_frames(voxels.filter(F.lit(False)), shape).count() == 0
