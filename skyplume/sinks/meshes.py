"""Meshes as binary glTF files of a bounded size."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes after which a task begins another file, and those of a mesh's description.
MOST, DESCRIBED = 4 << 20, 400


def encoded(parts: list[tuple[str, np.ndarray, np.ndarray]]) -> bytes:
    """A file of (name, vertices, faces); vertices are (east, north, up), the file is y up."""
    body, views, accessors, meshes = bytearray(), [], [], []
    for name, points, faces in parts:
        p = np.stack([points[:, 0], points[:, 2], -points[:, 1]], axis=1).astype("<f4")
        for raw, what in ((p.tobytes(), {"componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(axis=0).tolist(), "max": p.max(axis=0).tolist()}), (faces.astype("<u4").tobytes(), {"componentType": 5125, "count": faces.size, "type": "SCALAR"})):
            accessors.append(what | {"bufferView": len(views)})
            views.append({"buffer": 0, "byteOffset": len(body), "byteLength": len(raw)})
            body += raw
        meshes.append({"name": name, "primitives": [{"attributes": {"POSITION": len(accessors) - 2}, "indices": len(accessors) - 1}]})
    n = range(len(meshes))
    head = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [*n]}], "nodes": [{"mesh": k} for k in n], "meshes": meshes, "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(body)}]}
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<III", 0x46546C67, 2, 28 + len(text) + len(body)) + struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(body), 0x004E4942) + bytes(body)


def threes(column: pa.Array, kind: str) -> list[np.ndarray]:
    """An array (n, 3) for each row of lists of three numbers."""
    rows = column.flatten()
    if column.null_count or rows.null_count or pc.any(pc.not_equal(pc.list_value_length(rows), 3)).as_py():
        raise ValueError("points and faces are lists of three numbers")
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))[:-1]
    return np.split(rows.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, 3), ends)


def mesh_files(hulls: DataFrame, key: str, most: int = MOST) -> DataFrame:
    """(name, content): files ``key.task.number.glb`` of ``hulls`` (key, mesh, points array<array<double>>, faces array<array<int>>).

    Meshes are dealt out in order of key and name. A task begins another file with
    each key, and where a file has ``most`` bytes, so that what is held does not grow
    with a key's meshes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, now, parts, held = TaskContext.get().partitionId(), 0, None, [], 0
        file = lambda: pa.RecordBatch.from_pydict({"name": [f"{now}.{task}.{number}.glb"], "content": pa.array([encoded(parts)], pa.binary())})
        for b in batches:
            for ident, mesh, points, faces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), threes(b.column(2), "f8"), threes(b.column(3), "i8"), strict=True):
                if parts and (ident != now or held >= most):
                    yield file()
                    number, parts, held = number + 1, [], 0
                now = ident
                parts.append((mesh, points, faces))
                held += 12 * (len(points) + len(faces)) + DESCRIBED
        if parts:
            yield file()

    return hulls.select(key, "mesh", "points", "faces").repartitionByRange(key, "mesh").sortWithinPartitions(key, "mesh").mapInArrow(run, "name string, content binary")
