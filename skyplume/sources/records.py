"""Calibrations, annotations and telemetry as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def calibrations(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Calibration JSON of either schema as (keys, schema, video, blast_frame, t0, pivot_x, pivot_y, ppm); one that fits neither has a null schema."""
    # JSON keys differ by case only, so they are picked by path.
    at = lambda p, kind="double": F.get_json_object(text, f"$.{p}").try_cast(kind)
    flat, listed = at("PIVOT_X_NAT").isNotNull() | at("PPM_NAT").isNotNull(), at("pivots[0].x").isNotNull()
    pick = lambda a, b: F.when(flat, a).when(listed, b)
    return df.select(
        *keys, pick(F.lit("flat"), F.lit("pivots")).alias("schema"), pick(F.coalesce(at("VIDEO", "string"), at("video", "string")), at("video", "string")).alias("video"),
        pick(F.rint(at("T0_SUBFRAME")).cast("int"), at("blast_frame", "int")).alias("blast_frame"), pick(at("T0_SUBFRAME"), at("pivots[0].t0")).alias("t0"),
        pick(at("PIVOT_X_NAT"), at("pivots[0].x")).alias("pivot_x"), pick(at("PIVOT_Y_NAT"), at("pivots[0].y")).alias("pivot_y"),
        pick(at("PPM_NAT"), F.coalesce(at("pivots[0].ppm"), at("pixels_per_meter"))).alias("ppm"),
    )


def annotations(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, frame, polygon, points) of annotation JSON: a map of frames to lists of polygons."""
    rows = df.select(*keys, F.explode(F.from_json(F.get_json_object(text, "$.frames"), "map<string, array<array<array<double>>>>")).alias("frame", "_p"))
    return rows.select(*keys, F.col("frame").cast("long").alias("frame"), F.posexplode("_p").alias("polygon", "points"))


def polygon_area(points: Column) -> Column:
    """Area of a polygon given as an array of [x, y], by the shoelace formula; 0 for fewer than three points."""
    n = F.size(points)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(points, i)[0] * F.get(points, (i + 1) % n)[1] - F.get(points, (i + 1) % n)[0] * F.get(points, i)[1])
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2).otherwise(0.0)


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A base-128 number and where it ends; data that ends within it is an error."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> list[tuple[int, int, object]] | None:
    """(number, wire type, value) of a message's fields; None if the bytes are no message."""
    out, at = [], 0
    try:
        while at < len(data):
            key, at = varint(data, at)
            number, wire = key >> 3, key & 7
            if wire == 0:
                value, at = varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                value = struct.unpack_from("<d" if wire == 1 else "<f", data, at)[0]
                at += size
            elif wire == 2:
                size, at = varint(data, at)
                value = data[at : at + size]
                at += size
            else:
                return None
            if number == 0 or at > len(data):
                return None
            out.append((number, wire, value))
    except (IndexError, struct.error):
        return None
    return out


def walked(data: bytes, path: str = "", depth: int = 6) -> Iterator[tuple[str, float]]:
    """(path, value) of the numbers of a message and of the messages in it; integers of 64 bits are signed."""
    for number, wire, value in fields(data) or ():
        here = f"{path}.{number}"
        if wire != 2:
            yield here, float(value - (1 << 64) if wire == 0 and value >> 63 else value)
        elif depth and len(value) > 1:
            yield from walked(value, here, depth - 1)


def telemetry(samples: DataFrame, ident: str, data: str) -> DataFrame:
    """(ident, path, place, value): entity-attribute-value rows of message bytes; ``place`` numbers equal paths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, raw in zip(pdf[ident], pdf[data], strict=True):
                seen: dict[str, int] = {}
                for path, value in walked(bytes(raw) if raw is not None else b""):
                    rows.append((key, path, seen.get(path, 0), value))
                    seen[path] = seen.get(path, 0) + 1
            yield pd.DataFrame(rows, columns=[ident, "path", "place", "value"])

    return samples.select(ident, data).mapInPandas(run, f"{ident} {samples.schema[ident].dataType.simpleString()}, path string, place int, value double")


#: Fixed values of the message format. Path, name and how a value is scaled: radians to degrees, millimetres to metres, tenths of a degree to degrees.
TELEMETRY = {
    ".3.3.4.1.2": ("lat_deg", "radians"), ".3.3.4.1.3": ("lon_deg", "radians"), ".3.3.4.2": ("absolute_altitude_m", "milli"),
    ".3.3.3.3": ("drone_yaw_deg", "tenths"), ".3.3.3.1": ("drone_pitch_deg", "tenths"), ".3.3.3.2": ("drone_roll_deg", "tenths"),
    ".3.4.3.1": ("gimbal_pitch_deg", "tenths"), ".3.4.3.3": ("gimbal_yaw_deg", "tenths"), ".2.2.1": ("width", None), ".2.2.2": ("height", None), ".2.2.3": ("fps", None),
}


def telemetry_columns(rows: DataFrame, ident: str, table: dict = TELEMETRY) -> DataFrame:
    """One row a sample with the named fields in their units; the first value of a repeated field."""
    wide = rows.filter("place = 0").groupBy(ident).pivot("path", list(table)).agg(F.first("value"))
    scaled = {None: lambda c: c, "radians": F.degrees, "milli": lambda c: c / 1000, "tenths": lambda c: c / 10}
    return wide.select(ident, *[scaled[how](F.col(f"`{path}`")).alias(name) for path, (name, how) in table.items()])
