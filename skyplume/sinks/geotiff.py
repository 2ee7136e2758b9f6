"""Rasters as GeoTIFF files: tiled, deflated, 32-bit floating cells in a projected system."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from skyplume.operators.rasters import Grid

TILE = 64
NO_DATA = -9999.0


def encoded(z: np.ndarray, west: float, north: float, res: float, system: int, tile: int = TILE, predictor: int = 3) -> bytes:
    """A file's bytes; ``z`` has the northernmost row first, NaN where there is no data."""
    height, width = z.shape
    z = np.where(np.isfinite(z), z, NO_DATA).astype("<f4")
    down, across = -(-height // tile), -(-width // tile)
    wide = np.full((down * tile, across * tile), NO_DATA, "<f4")
    wide[:height, :width] = z
    blocks = []
    for k in range(down * across):
        r, c = k // across * tile, k % across * tile
        part = np.ascontiguousarray(wide[r : r + tile, c : c + tile])
        if predictor == 3:
            split = part.astype(">f4").view(np.uint8).reshape(tile, tile, 4).transpose(0, 2, 1).reshape(tile, -1)
            part = np.diff(split, axis=1, prepend=np.zeros((tile, 1), np.uint8))
        blocks.append(zlib.compress(part.tobytes()))
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, system)
    text = f"{NO_DATA:g}".encode() + b"\0"
    # (tag, type, values) in ascending order, as the format asks for.
    tags = [
        (256, "I", (width,)), (257, "I", (height,)), (258, "H", (32,)), (259, "H", (8,)), (262, "H", (1,)), (277, "H", (1,)), (284, "H", (1,)), (317, "H", (predictor,)), (322, "H", (tile,)), (323, "H", (tile,)),
        (324, "I", (0,) * len(blocks)), (325, "I", tuple(map(len, blocks))), (339, "H", (3,)), (33550, "d", (res, res, 0.0)), (33922, "d", (0.0, 0.0, 0.0, west, north, 0.0)), (34735, "H", keys), (42113, "s", (text,)),
    ]
    code = {"s": 2, "H": 3, "I": 4, "d": 12}
    body_at = 8 + 2 + 12 * len(tags) + 4
    packed = lambda kind, v: v[0] if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
    far = sum(len(x) + len(x) % 2 for x in (packed(k, v) for _, k, v in tags) if len(x) > 4)
    at = body_at + far
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tags = [(t, k, tuple(offsets) if t == 324 else v) for t, k, v in tags]
    entries, body = b"", b""
    for tag, kind, values in tags:
        raw = packed(kind, values)
        if len(raw) > 4:
            here = struct.pack("<I", body_at + len(body))
            body += raw + b"\0" * (len(raw) % 2)
        else:
            here = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, code[kind], len(raw) if kind == "s" else len(values)) + here
    return struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + entries + struct.pack("<I", 0) + body + b"".join(blocks)


def rasters(cells: DataFrame, key: str, grid: Grid, system: int) -> DataFrame:
    """(name, content): a file for each ``key`` of ``cells`` (key, ix, iy, z), iy from the south; a raster is bounded by its grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.full((grid.ny, grid.nx), np.nan)
        z[grid.ny - 1 - pdf["iy"], pdf["ix"]] = pdf["z"].astype(float)
        raw = encoded(z, grid.x0 - grid.res / 2, grid.y0 + (grid.ny - 0.5) * grid.res, grid.res, system)
        return pd.DataFrame({"name": [f"{pdf[key].iloc[0]}.tif"], "content": [raw]})

    return cells.select(key, "ix", "iy", "z").groupBy(key).applyInPandas(run, "name string, content binary")
