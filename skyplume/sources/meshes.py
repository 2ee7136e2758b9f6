"""Hulls from binary glTF files: meshes to vertices and faces, and from these volumes, centres and spreads.

A file holds one mesh a frame, named with its number; an ident with many frames has
several files. Files are read in tasks (``meshes_of``), a file at a time, so that one
has to fit into a task's memory; each mesh is bounded by a frame's grid. ``solid_moments`` sums signed
tetrahedra over the faces, so a closed mesh's moments are exact whatever its
shape. ``hull_heights`` and ``hull_profile`` then are column expressions over a row
a mesh: where the hull is, whether the series trusts it, and how far it spreads
along and across the wind.

glTF is y up; here x is east, y north and z up: (x, -z, y).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.operators.fits import directional_sigma
from skyplume.operators.quantiles import quantiles
from skyplume.sources.folder import settled

#: Fixed values of the format: magic, chunk kinds, component types, components by type, triangles.
MAGIC, JSON_CHUNK, BINARY_CHUNK = 0x46546C67, 0x4E4F534A, 0x004E4942
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
PARTS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
TRIANGLES = 4
#: Frames that are lined up together, and meshes that a task describes at a time.
STRETCH, ROWS = 4096, 4096
#: Tasks that an ident's rows are dealt to.
DEAL = 32
ROW = "mesh string, n_vertices long, n_faces long, closed boolean, volume double, east double, north double, up double, top double, see double, snn double, suu double, sen double"


def chunks(data: bytes) -> tuple[dict, bytes]:
    """The description and the binary part of a file."""
    if len(data) < 12 or struct.unpack_from("<II", data)[:2] != (MAGIC, 2):
        raise ValueError("not a binary glTF 2 file")
    end = min(len(data), struct.unpack_from("<I", data, 8)[0])
    at, found = 12, {}
    while at + 8 <= end:
        size, kind = struct.unpack_from("<II", data, at)
        if at + 8 + size > len(data):
            raise ValueError("the file ends within a chunk")
        found.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size
    if JSON_CHUNK not in found:
        raise ValueError("the file has no description")
    return json.loads(found[JSON_CHUNK]), found.get(BINARY_CHUNK, b"")


def accessor(head: dict, body: bytes, number: int) -> np.ndarray:
    """(count, parts) numbers of an accessor, read through its view's stride; without a view zeros."""
    a = head["accessors"][number]
    if a["componentType"] not in COMPONENTS or a["type"] not in PARTS or "sparse" in a:
        raise ValueError("accessors of this kind can't be read")
    kind, parts, n = np.dtype(COMPONENTS[a["componentType"]]), PARTS[a["type"]], a["count"]
    if "bufferView" not in a:
        return np.zeros((n, parts), kind)
    view = head["bufferViews"][a["bufferView"]]
    if view.get("buffer", 0) or "uri" in head["buffers"][0]:
        raise ValueError("only the file's own binary part can be read")
    start, step = view.get("byteOffset", 0) + a.get("byteOffset", 0), view.get("byteStride", kind.itemsize * parts)
    if n and start + (n - 1) * step + kind.itemsize * parts > len(body):
        raise ValueError("an accessor reaches beyond the binary part")
    return np.ndarray((n, parts), kind, body, start, (step, kind.itemsize)).copy()


def meshes(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(name, vertices, faces) of each mesh: its triangles put together, equal vertices one."""
    head, body = chunks(data)
    for k, mesh in enumerate(head.get("meshes", [])):
        points, faces, n = [np.zeros((0, 3))], [np.zeros((0, 3), np.int64)], 0
        for part in mesh["primitives"]:
            if part.get("mode", TRIANGLES) != TRIANGLES or "POSITION" not in part["attributes"]:
                continue
            p = accessor(head, body, part["attributes"]["POSITION"]).astype(float)
            index = accessor(head, body, part["indices"])[:, 0].astype(np.int64) if "indices" in part else np.arange(len(p))
            if len(index) and index.max() >= len(p):
                raise ValueError("a face has a vertex that is not there")
            points.append(p)
            faces.append(index[: len(index) // 3 * 3].reshape(-1, 3) + n)
            n += len(p)
        unique, place = np.unique(np.concatenate(points), axis=0, return_inverse=True)
        yield mesh.get("name", f"mesh_{k}"), unique, place.reshape(-1)[np.concatenate(faces)]


def closed(faces: np.ndarray) -> bool:
    """Whether each edge has one face on either side, both turned alike."""
    if not len(faces):
        return False
    a, b = faces[:, [0, 1, 2]].ravel(), faces[:, [1, 2, 0]].ravel()
    n = int(faces.max()) + 1
    there, back = np.sort(a * n + b), np.sort(b * n + a)
    return bool((a != b).all() and (np.diff(there) > 0).all() and (there == back).all())


def solid_moments(points: np.ndarray, faces: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Signed volume, centre and covariance of what a closed surface encloses."""
    origin = points.mean(axis=0)  # near the solid, for precision
    t = points[faces] - origin
    six = np.einsum("ij,ij->i", t[:, 0], np.cross(t[:, 1], t[:, 2]))
    volume = six.sum() / 6
    if volume == 0:
        return 0.0, origin, np.zeros((3, 3))
    total = t.sum(axis=1)
    centre = (six[:, None] * total).sum(axis=0) / 24 / volume
    second = (np.einsum("i,ikp,ikq->pq", six, t, t) + np.einsum("i,ip,iq->pq", six, total, total)) / 120 / volume
    return float(volume), centre + origin, second - np.outer(centre, centre)


def described(name: str, points: np.ndarray, faces: np.ndarray) -> tuple:
    """A row of ``ROW``. Without a closed surface there are no moments, and the centre is the mean of the vertices."""
    p = np.stack([points[:, 0], -points[:, 2], points[:, 1]], axis=1)
    top = float(p[:, 2].max()) if len(p) else None
    volume, centre, spread = solid_moments(p, faces) if closed(faces) else (0.0, None, None)
    if volume == 0:
        centre = p.mean(axis=0).tolist() if len(p) else [None] * 3
        return name, len(p), len(faces), False, None, *centre, top, None, None, None, None
    # A surface turned inside out encloses the same.
    return name, len(p), len(faces), True, abs(volume), *centre.tolist(), top, spread[0, 0], spread[1, 1], spread[2, 2], spread[0, 1]


def meshes_of(files: DataFrame, ident: str, content: str) -> DataFrame:
    """(ident, mesh, frame, n_vertices, n_faces, closed, volume, east, north, up, top, see, snn, suu, sen) of the meshes of glTF files held as bytes.

    ``frame`` is the first number in the mesh's name, null without one; see to sen
    are the covariances of the enclosed solid. A file that is not binary glTF is
    an error.
    """
    kind = files.schema[ident].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [ident, *(x.split()[0] for x in ROW.split(", "))]
        for b in batches:
            types = [b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.float64()] * 9]
            rows = ((name, *described(*m)) for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in meshes(data.as_py()))
            while some := list(islice(rows, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    rows = files.select(ident, content).mapInArrow(run, f"{ident} {kind.simpleString()}, {ROW}")
    return rows.withColumn("frame", F.nullif(F.regexp_extract("mesh", r"(\d+)", 1), F.lit("")).cast("long"))


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """``meshes_of`` all .glb files under ``path``; ``file`` is the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").load(path)
    return meshes_of(files.select(F.col("path").alias("file"), "content"), "file", "content")


def dealt_join(rows: DataFrame, few: DataFrame, ident: str, how: str) -> DataFrame:
    """``rows`` (ident, frame, ...) joined with ``few``, a row an ident, which is repeated so that an ident's rows go to ``DEAL`` tasks."""
    few = few.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    return rows.withColumn("_deal", F.pmod(F.xxhash64("frame"), F.lit(DEAL)).cast("int")).join(few, [ident, "_deal"], how).drop("_deal")


def hull_heights(hulls: DataFrame, ident: str, z_floor: float, series: DataFrame | None = None, weak: str = "no shadow") -> DataFrame:
    """(ident, frame, east, north, up, top, z, confident) of each frame's hull.

    ``z`` is the centre's height over ``z_floor``. A frame is confident where
    ``series`` (ident, frame, mode) has it with another mode than ``weak``; if it
    has none such of an ident's hulls, or there is no series, all of that ident
    are. With a series the hulls are computed once and kept in the shared folder.
    """
    rows = hulls.filter("frame is not null").select(ident, "frame", "east", "north", "up", "top", (F.col("up") + z_floor).alias("z"))
    if series is None:
        return rows.withColumn("confident", F.lit(True))
    good = series.groupBy(ident, "frame").agg(F.bool_or(F.coalesce(F.col("mode"), F.lit("")) != weak).alias("_good"))
    rows = settled(rows.join(good, [ident, "frame"], "left").withColumn("_good", F.coalesce("_good", F.lit(False))))
    trusted = rows.groupBy(ident).agg(F.bool_or("_good").alias("_any"))  # a row an ident
    return dealt_join(rows, trusted, ident, "inner").select(*rows.columns[:-1], (F.col("_good") | ~F.col("_any")).alias("confident"))


def voxel_step(series: DataFrame, ident: str) -> DataFrame:
    """(ident, step): median edge of a voxel, from the volumes and voxel counts of ``series`` (ident, vol, n_vox)."""
    edge = F.pow(F.col("vol") / F.col("n_vox"), F.lit(1 / 3))
    return quantiles(series.filter("n_vox > 0 and vol > 0"), [ident], edge, [0.5], ["step"])


def major_azimuth(see: Column, snn: Column, sen: Column) -> Column:
    """Azimuth, 0 to 180 degrees from north, of the longer axis of a horizontal covariance."""
    return F.pmod(90 - F.degrees(F.atan2(2 * sen, see - snn)) / 2, F.lit(180.0))


def hull_profile(hulls: DataFrame, ident: str, azimuth: float, series: DataFrame | None = None, fps: float | None = None, first_frame: float | None = None) -> DataFrame:
    """(ident, frame, t, volume, east, north, up, top, along, across, vertical, azimuth, resolved) of the closed hulls.

    ``azimuth`` (degrees) is where the wind blows to. Times come from ``series``
    (ident, frame, t, vol, n_vox), else from ``fps`` and ``first_frame``; a hull
    without a time is left with a null one. ``resolved``: the vertical spread is 1.5
    voxels or more, by the ident's ``voxel_step``; true where that is not known.
    """
    rows = hulls.filter("closed and frame is not null")
    along, across = directional_sigma(F.col("see"), F.col("snn"), F.col("sen"), azimuth)
    clock = (F.col("frame") - F.lit(first_frame)) / F.lit(fps) if fps is not None and first_frame is not None else F.lit(None).cast("double")
    if series is not None:
        rows = dealt_join(rows.join(series.groupBy(ident, "frame").agg(F.max("t").alias("_t")), [ident, "frame"], "left"), voxel_step(series, ident), ident, "left")
        clock, step = F.coalesce("_t", clock), F.col("step")
    else:
        step = F.lit(None).cast("double")
    vertical = F.sqrt(F.greatest("suu", F.lit(0.0)))
    return rows.select(
        ident, "frame", clock.alias("t"), "volume", "east", "north", "up", "top", along.alias("along"), across.alias("across"), vertical.alias("vertical"),
        major_azimuth(F.col("see"), F.col("snn"), F.col("sen")).alias("azimuth"), F.coalesce(vertical >= 1.5 * step, F.lit(True)).alias("resolved"),
    )


def last_confident(frames: DataFrame, heights: DataFrame, ident: str) -> DataFrame:
    """(ident, frame, z) for ``frames`` (ident, frame): the confident heights between their frames, and beyond them the nearest one.

    Frames and heights are lined up within stretches of ``STRETCH`` frames, so that
    an ident with many frames is dealt out; what a stretch lacks at its edges comes
    from the ends of the others, a row a stretch. Both tables are read twice.
    """
    stretch = F.floor(F.col("frame") / STRETCH).alias("_s")
    known = heights.filter("confident and frame is not null").select(ident, "frame", stretch, F.lit(0).alias("_q"), F.struct("frame", "z").alias("_p"))
    line = known.union(frames.select(ident, "frame", stretch, F.lit(1), F.lit(None).cast(known.schema["_p"].dataType)))
    # Only frames that begin with the first row: Spark goes through the rest of a key anew for each row of one that ends with the last.
    before = lambda c, order, end: F.last(c, True).over(order.rowsBetween(W.unboundedPreceding, end))
    here, all_of = W.partitionBy(ident, "_s"), W.partitionBy(ident)
    rows = line.withColumns({"_a": before("_p", here.orderBy("frame", "_q", "_p"), 0), "_b": before("_p", here.orderBy(F.desc("frame"), "_q", F.desc("_p")), 0)}).filter("_q = 1")
    ends = line.groupBy(ident, "_s").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    ends = ends.select(ident, "_s", before("_last", all_of.orderBy("_s"), -1).alias("_l"), before("_first", all_of.orderBy(F.desc("_s")), -1).alias("_r"))
    rows = rows.join(ends, [ident, "_s"], "left").withColumns({"_a": F.coalesce("_a", "_l"), "_b": F.coalesce("_b", "_r")})
    a, b = F.col("_a"), F.col("_b")
    part = (F.col("frame") - a["frame"]) / (b["frame"] - a["frame"])
    inside = F.when(b["frame"] > a["frame"], a["z"] + part * (b["z"] - a["z"])).otherwise(a["z"])
    return rows.select(ident, "frame", F.when(a.isNull(), b["z"]).when(b.isNull(), a["z"]).otherwise(inside).alias("z"))
