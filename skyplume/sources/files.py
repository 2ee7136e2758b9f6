"""Files by range, wherever they are, and a sink of files by name.

``opened`` reads any range of a file of the file systems that Arrow knows
(local, S3, GCS, HDFS). ``NamedFiles`` writes rows (name, content) as files: a
task writes under a folder of its own attempt, and the driver moves what the
successful attempts name once all have ended, so lost executors leave no half files
and repeated tasks no second copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def opened(uri: str) -> pa.NativeFile:
    """A file that can be read by range."""
    system, path = located(uri)
    return system.open_input_file(path)


def listed(uri: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of a folder's files with one of the ``endings``, by name; hidden ones apart."""
    system, path = located(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    inside = [x for x in found if x.type == fs.FileType.File and x.base_name.lower().endswith(endings) and not any(p[0] in "._" for p in x.path[len(path) :].split("/") if p)]
    return sorted((uri.rstrip("/") + "/" + x.path[len(path) :].lstrip("/"), x.size) for x in inside)


@dataclass
class Wrote(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, target: str):
        self.target, self.staged = target.rstrip("/"), f"{target.rstrip('/')}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Wrote:
        folder, names = f"{self.staged}/{uuid.uuid4().hex}", []
        system, path = located(folder)
        system.create_dir(path, recursive=True)
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name[0] in "._":
                raise ValueError(f"not a name for a file: {name!r}")
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(bytes(row["content"]))
            names.append(name)
        return Wrote(folder, names)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, path = located(self.target)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several rows have the same name")
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{located(m.folder)[1]}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Wrote | None]) -> None:
        system, path = located(self.staged)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("append").save(folder)`` for rows (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if overwrite or not {"name", "content"} <= set(schema.names):
            raise ValueError("named_files appends rows (name, content)")
        return NamedFilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes rows (name, content) as files of ``folder``; a name that is there already is replaced, one that comes twice is an error."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "content").write.format("named_files").mode("append").save(folder)
