"""GeoTIFF rasters as cell tables, read block by block.

``read_geotiff`` gives (file, col, row, x, y, z) of the first band's cells; x and
y are of their centres. It is a Python data source: comparisons on x, y, col and
row that a query makes are pushed down to it and turned into a box of blocks
(tiles or strips), and only these are fetched by range and decoded. Spark still
checks the comparisons, so pushing them changes what is read and not the result.
Large files are dealt out over several tasks, each of which takes some of the
blocks.

Read are classic and big files of either byte order, strips and tiles, all
widths of whole and floating numbers, uncompressed, LZW and deflated, with or
without predictor. A raster that is rotated, has no place on the ground or is
not in a projected system is an error, as heights and lengths would not agree.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from skyplume.sources.files import listed, opened

#: Fixed values of the format: tags, types by code as struct letters, compressions, keys.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_KIND = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
MODEL_KEY, RASTER_KEY, SYSTEM_KEY, PROJECTED, POINT = 1024, 1025, 3072, 1, 2
#: Bytes of a file that a task takes.
SHARE = 64 << 20
SCHEMA = "file string, col int, row int, x double, y double, z double"


@dataclass(frozen=True)
class Raster:
    """What a file's first directory says: size, blocks, how they are coded, and the place of cell (0, 0)'s outer corner."""

    width: int
    height: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    kind: np.dtype
    bands: int
    compression: int
    predictor: int
    nodata: float | None
    corner: tuple[float, float]
    step: tuple[float, float]
    system: int | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])

    def x(self, col: np.ndarray) -> np.ndarray:
        return self.corner[0] + (col + 0.5) * self.step[0]

    def y(self, row: np.ndarray) -> np.ndarray:
        return self.corner[1] + (row + 0.5) * self.step[1]

    def window(self, west: float, south: float, east: float, north: float) -> tuple[int, int, int, int]:
        """First column and row and their ends of the cells of a box: offsets are rounded down, lengths up."""
        col, row = (west - self.corner[0]) / self.step[0], (north - self.corner[1]) / self.step[1]
        wide, high = (east - west) / self.step[0], (south - north) / self.step[1]
        first = [math.floor(round(v, 6)) for v in (col, row)]
        end = [f + math.ceil(round(n, 6)) for f, n in zip(first, (wide, high), strict=True)]
        return max(0, first[0]), max(0, first[1]), min(self.width, end[0]), min(self.height, end[1])


def directory(source: pa.NativeFile) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of the first directory's tags."""
    head = source.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(f"{order}H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(f"{order}Q", head, 8)[0] if big else struct.unpack_from(f"{order}I", head, 4)[0]
    count = struct.unpack(f"{order}{'Q' if big else 'H'}", source.read_at(8 if big else 2, at))[0]
    at += 8 if big else 2
    size, room = (20, 8) if big else (12, 4)
    raw, tags = source.read_at(count * size, at), {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HH{'Q' if big else 'I'}", raw, k * size)
        if kind not in TYPES:
            continue
        form = f"{order}{n}{TYPES[kind]}"
        here = raw[(k + 1) * size - room : (k + 1) * size]
        if struct.calcsize(form) > room:
            here = source.read_at(struct.calcsize(form), struct.unpack(f"{order}{'Q' if big else 'I'}", here)[0])
        tags[tag] = struct.unpack_from(form, here)
    return order, tags


def placed(tags: dict[int, tuple]) -> tuple[tuple[float, float], tuple[float, float], int | None]:
    """Outer corner of the first cell, step by column and row, and the system's code."""
    keys = tags.get(GEO_KEYS, ())
    key = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    if key.get(MODEL_KEY) != PROJECTED:
        raise ValueError("the raster is not in a projected system")
    if TRANSFORM in tags:
        a, b, _, x, d, e, _, y = tags[TRANSFORM][:8]
        if b or d:
            raise ValueError("the raster is rotated")
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        i, j, _, x, y, _ = tags[TIE_POINT][:6]
        a, e = tags[PIXEL_SCALE][0], -tags[PIXEL_SCALE][1]
        x, y = x - i * a, y - j * e
    else:
        raise ValueError("the raster has no place on the ground")
    if key.get(RASTER_KEY) == POINT:  # the point given is the first cell's centre
        x, y = x - a / 2, y - e / 2
    if a <= 0 or e >= 0:
        raise ValueError("the raster is rotated")
    return (x, y), (a, e), key.get(SYSTEM_KEY)


def described(source: pa.NativeFile) -> Raster:
    """The first raster of a file; what can't be read is an error."""
    order, tags = directory(source)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    bits, kind = one(BITS, 1), {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_KIND, 1))
    compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    if kind is None or bits not in (8, 16, 32, 64) or kind == "f" and bits == 8 or compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2, 3) or predictor == 3 and kind != "f":
        raise ValueError(f"cells of kind {kind} and {bits} bits, compression {compression} and predictor {predictor} can't be read")
    tiled = TILE_OFFSETS in tags
    block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(one(STRIP_ROWS, height), height), width)
    corner, step, system = placed(tags)
    text = b"".join(tags.get(NO_DATA, ())).split(b"\0")[0].strip().decode()
    separate = one(PLANES, 1) == 2
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    return Raster(width, height, block, offsets, counts, np.dtype(f"{order}{kind}{bits // 8}"), 1 if separate else bands, compression, predictor, float(text) if text else None, corner, step, system)


def expanded(data: bytes) -> bytes:
    """LZW: codes of 9 to 12 bits, the highest bit first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        table = table or list(base)
        if last:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        else:
            entry = table[code]
        out += entry
        last = entry
        # The reader's table is one entry behind the writer's, which widens a code early.
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def block_cells(raster: Raster, data: bytes, rows: int) -> np.ndarray:
    """(rows, width) of the first band of a block."""
    if raster.compression == LZW:
        data = expanded(data)
    elif raster.compression != PLAIN:
        data = zlib.decompress(data)
    wide, bands, size = raster.block[1], raster.bands, raster.kind.itemsize
    data = data[: rows * wide * bands * size]
    if raster.predictor == 3:
        # Bytes of a row are split by significance, the highest first, and differ from those before.
        split = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1, bands), axis=1, dtype=np.uint8).reshape(rows, size, wide, bands)
        return np.ascontiguousarray(split.transpose(0, 2, 3, 1)).view(f">f{size}").reshape(rows, wide, bands)[:, :, 0]
    cells = np.frombuffer(data, raster.kind).reshape(rows, wide, bands)[:, :, 0]
    if raster.predictor == 2:
        plain = np.dtype(f"u{size}")
        cells = np.cumsum(cells.astype(raster.kind.newbyteorder("=")).view(plain), axis=1, dtype=plain).view(raster.kind.newbyteorder("="))
    return cells


@dataclass
class Box:
    """Bounds (ends included) that filters put on the columns; a cell's column and row are judged by its centre."""

    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)

    def narrow(self, f: Filter) -> None:
        """Takes the bound of a comparison with a number; others are left to Spark."""
        name, value = getattr(f, "attribute", ("",))[0], getattr(f, "value", None)
        if name not in ("x", "y", "col", "row") or isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
            return
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.least[name] = max(value, self.least.get(name, -math.inf))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.most[name] = min(value, self.most.get(name, math.inf))

    def meets(self, raster: Raster, col: int, row: int, wide: int, high: int) -> bool:
        """Whether cells of a block can lie within; a hair's breadth is left for rounding."""
        spans = {"col": (col, col + wide - 1), "row": (row, row + high - 1), "x": (raster.x(col), raster.x(col + wide - 1)), "y": (raster.y(row + high - 1), raster.y(row))}
        slack = {"x": 1e-6 * raster.step[0], "y": -1e-6 * raster.step[1]}
        return all(hi + slack.get(n, 0) >= self.least.get(n, -math.inf) and lo - slack.get(n, 0) <= self.most.get(n, math.inf) for n, (lo, hi) in spans.items())


@dataclass
class Share(InputPartition):
    """Every ``of``-th block of a file, from ``number`` on."""

    file: str
    number: int
    of: int


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, bounds: tuple[float, ...] | None):
        self.path, self.bounds, self.box = path, bounds, Box()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.box.narrow(f)
            yield f  # blocks are chosen here, cells by Spark

    def partitions(self) -> list[Share]:
        out = []
        for file, size in listed(self.path, (".tif", ".tiff")):
            parts = size // SHARE + 1
            out += [Share(file, k, parts) for k in range(parts)]
        return out

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        with opened(share.file) as source:
            raster = described(source)
            left, top, right, bottom = raster.window(*self.bounds) if self.bounds else (0, 0, raster.width, raster.height)
            high, wide = raster.block
            for k in range(share.number, raster.across * raster.down, share.of):
                row, col = k // raster.across * high, k % raster.across * wide
                n_rows, n_cols = min(high, raster.height - row), min(wide, raster.width - col)
                if row + n_rows <= top or row >= bottom or col + n_cols <= left or col >= right or not self.box.meets(raster, col, row, n_cols, n_rows):
                    continue
                if raster.counts[k]:
                    # The last strip ends with the raster; tiles are padded.
                    z = block_cells(raster, source.read_at(raster.counts[k], raster.offsets[k]), n_rows if wide == raster.width else high)[:n_rows, :n_cols].astype(float)
                else:  # a block that the writer has left out has no data
                    z = np.full((n_rows, n_cols), np.nan)
                rows, cols = np.indices(z.shape)
                rows, cols, z = (rows + row).ravel(), (cols + col).ravel(), z.ravel()
                keep = (rows >= top) & (rows < bottom) & (cols >= left) & (cols < right)
                rows, cols, z = rows[keep], cols[keep], z[keep]
                missing = ~np.isfinite(z) | (z == (math.nan if raster.nodata is None else raster.nodata))
                columns = [pa.array([share.file] * len(z), pa.string()), pa.array(cols, pa.int32()), pa.array(rows, pa.int32()), pa.array(raster.x(cols)), pa.array(raster.y(rows)), pa.array(z, mask=missing)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "col", "row", "x", "y", "z"])


class GeoTiff(DataSource):
    """``spark.read.format("geotiff_cells").load(path)``; option ``bounds``: west, south, east, north."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GeoTiffReader:
        bounds = self.options.get("bounds")
        return GeoTiffReader(self.options["path"], tuple(map(float, bounds.split(","))) if bounds else None)


def read_geotiff(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(file, col, row, x, y, z) of the cells of a file or of a folder's files; row 0 is the northernmost; z is null where there is no data.

    ``bounds`` (west, south, east, north) gives each raster's window: the cells
    from the one that holds the box's corner, offsets rounded down and lengths
    up. Filters on the result narrow further what is read.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    reader = spark.read.format("geotiff_cells")
    if bounds:
        reader = reader.option("bounds", ",".join(map(repr, map(float, bounds))))
    return reader.load(path)


def as_grid(cells: DataFrame) -> DataFrame:
    """(file, ix, iy, x, y, z): cells of windows numbered from the south-west, as ``operators.rasters`` takes them."""
    from pyspark.sql import functions as F

    ends = cells.groupBy(F.col("file").alias("_f")).agg(F.min("col").alias("_c"), F.max("row").alias("_r"))  # a row a file
    return cells.join(ends, F.col("file") == F.col("_f")).select("file", (F.col("col") - F.col("_c")).alias("ix"), (F.col("_r") - F.col("row")).alias("iy"), "x", "y", "z")
