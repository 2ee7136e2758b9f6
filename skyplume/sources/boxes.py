"""Binary containers: the box tree of an MP4 file, and its chunk table as rows."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Boxes that hold boxes.
PARENTS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl"))
#: Seconds from 1904-01-01 to 1970-01-01.
EPOCH_1904 = 2_082_844_800


def walk(data: bytes, start: int = 0, stop: int | None = None, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, first byte, end) of each box's content; a box that runs beyond its parent ends the walk."""
    at, stop = start, len(data) if stop is None else stop
    while at + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= stop:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or stop - at
        if size < head or at + size > stop:
            return
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, at + head, at + size
        if kind in PARENTS:
            yield from walk(data, at + head, at + size, here)
        at += size


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(file, box, offset, size) of all files under ``path``, and ``created`` (from mvhd) where known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                for box, lo, hi in walk(data):
                    raw = None
                    if box.endswith("/mvhd") and hi - lo >= 12:
                        raw = struct.unpack_from(">Q" if data[lo] == 1 else ">I", data, lo + 4)[0]
                    rows.append((name, box, lo, hi - lo, raw))
            yield pd.DataFrame(rows, columns=["file", "box", "offset", "size", "raw"]).astype({"raw": "Int64"})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, box string, offset long, size long, raw long")
    return rows.select("file", "box", "offset", "size", F.timestamp_seconds(F.when(F.col("raw") > 0, F.col("raw") - EPOCH_1904)).alias("created"))


def sample_table(data: bytes, codec: bytes | None = None) -> list[tuple[int, int]]:
    """(offset, size) of the samples of the first track whose description has ``codec``.

    Sizes come from stsz (one for all, or one each), chunk offsets from stco or
    co64; stsc says from which chunk on a chunk has how many samples. Samples
    that the tables do not reach are left out; a file without such a track is an
    error.
    """
    tables: dict[int, dict[str, bytes]] = {}
    track = -1
    for box, lo, hi in walk(data):
        if box == "/moov/trak":
            track += 1
        if box.startswith("/moov/trak/mdia/minf/stbl/"):
            tables.setdefault(track, {}).setdefault(box.rsplit("/", 1)[1], data[lo:hi])
    for found in tables.values():
        if codec is not None and codec not in found.get("stsd", b""):
            continue
        if not {"stsz", "stsc"} <= set(found) or not {"stco", "co64"} & set(found):
            continue
        one, count = struct.unpack_from(">II", found["stsz"], 4)
        sizes = [one] * count if one else list(struct.unpack_from(f">{count}I", found["stsz"], 12))
        wide = "stco" not in found
        raw = found["co64" if wide else "stco"]
        chunks = struct.unpack_from(f">{struct.unpack_from('>I', raw, 4)[0]}{'Q' if wide else 'I'}", raw, 8)
        runs = [struct.unpack_from(">II", found["stsc"], 8 + 12 * k) for k in range(struct.unpack_from(">I", found["stsc"], 4)[0])]
        out: list[tuple[int, int]] = []
        per = runs[0][1] if runs else 0
        starts = dict(runs)
        for number, at in enumerate(chunks, 1):
            per = starts.get(number, per)
            for size in sizes[len(out) : len(out) + per]:
                out.append((at, size))
                at += size
        return out
    raise ValueError("no track with such samples")


def samples_of(files: DataFrame, ident: str, content: str, codec: bytes | None = None) -> DataFrame:
    """(ident, sample, offset, size) of the samples of ``sample_table`` of container files held as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, k, at, size) for name, data in zip(pdf[ident], pdf[content], strict=True) for k, (at, size) in enumerate(sample_table(bytes(data), codec))]
            yield pd.DataFrame(rows, columns=[ident, "sample", "offset", "size"])

    return files.select(ident, content).mapInPandas(run, f"{ident} {files.schema[ident].dataType.simpleString()}, sample long, offset long, size long")


def read_samples(spark: SparkSession, path: str, codec: bytes | None = None) -> DataFrame:
    """``samples_of`` all files under ``path``."""
    return samples_of(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"), "file", "content", codec)


def expand_chunks(chunks: DataFrame, chunk: str, per: str, size_of: Callable[[Column], Column]) -> DataFrame:
    """(chunk, i, position): the samples of each chunk, and their place from the chunk's start by the sizes of those before."""
    rows = chunks.select(chunk, F.explode(F.sequence(F.lit(0), F.col(per) - 1)).alias("i"))
    size = size_of(F.col("i"))
    before = F.sum(size).over(W.partitionBy(chunk).orderBy("i").rowsBetween(W.unboundedPreceding, 0)) - size
    return rows.select(chunk, F.col("i").cast("long").alias("i"), before.cast("long").alias("position"))
