"""Token ids as binary files with a shared zstandard dictionary.

Format (two Parquet folders that Spark writes and commits, so lost executors
leave no half files): ``dictionary`` has one row, the dictionary and its
SHA-256; ``blocks`` has rows of some 128 KB each with the documents' ids, one
zstandard frame for each document, the offset index of the frames and the hash
of the dictionary they need. A short document is read by its offset without
decompressing its neighbours. Blocks are in ascending doc_id order.

The dictionary is trained on a bounded sample (``SAMPLE`` documents, ``PREFIX``
bytes of serialised ids of each); every document is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.llm.common import fresh_path, sliced
from skyplume.llm.tokens import encoder

SAMPLE, PREFIX, DICTIONARY = 400, 16_384, 32_768
BLOCK = 1 << 17
#: Bytes of text that a writer's task takes, as long as that makes no more than PARTS tasks.
PART, PARTS = 1 << 24, 20_000
BLOCKS = "part int, seq int, first_token long, n_tokens long, dict_hash string, min_id long, max_id long, doc_ids array<long>, offsets array<int>, payload binary"


def encoded(batch: pa.RecordBatch, vocabulary: str, end_id: int) -> list[np.ndarray]:
    """Ids of the batch's column ``text`` (null: empty), each with the end id."""
    texts = [x or "" for x in batch.column("text").to_pylist()]
    return [np.append(x, np.uint32(end_id)).astype("<u4") for x in encoder(vocabulary).ids(texts)]


def train(samples: list[bytes]) -> bytes:
    """A dictionary for ``samples``; few or tiny samples make a plain one of their bytes, none an empty one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY]


def usable(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def sampled(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the ``SAMPLE`` documents that come first by the hash of their id; of several with an id, the text that is least.

    Ids are chosen alone, so that no task gets more texts than its own documents
    and its share of the sample. Where ids repeat there may be fewer.
    """
    first = docs.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).distinct()
    return docs.select("doc_id", "text").join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def sample_dictionary(docs: DataFrame, vocabulary: str, end_id: int) -> bytes:
    """Trained on the documents of ``sampled``; the driver gets SAMPLE x PREFIX bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()[:PREFIX] for x in encoded(b, vocabulary, end_id)], pa.binary())], ["raw"])

    return train(sorted(bytes(r["raw"]) for r in sampled(docs).mapInArrow(run, "raw binary").collect()))


def write_ids(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Writes the ids of every row of ``docs`` (doc_id, text) under ``path``.

    Each document's ids end with ``end_id``; a null text is empty. Rows are in
    ascending order of doc_id, nulls first, equal doc_ids by the checksum of
    their text. Texts of any length are one document. An empty table makes files
    without blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    raw = sample_dictionary(docs, vocabulary, end_id)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, dict_data=usable(raw), write_checksum=False)
        part, seq, first, tokens = TaskContext.get().partitionId(), 0, 0, 0
        ids, offsets, frames = [], [0], []

        def block() -> pa.RecordBatch:
            real = [i for i in ids if i is not None]
            row = {"part": part, "seq": seq, "first_token": first, "n_tokens": tokens - first, "dict_hash": digest, "min_id": min(real, default=None), "max_id": max(real, default=None), "doc_ids": ids, "offsets": offsets, "payload": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("dict_hash", pa.string()), ("min_id", pa.int64()), ("max_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary())])
        for b in sliced(batches):
            for doc_id, x in zip(b.column("doc_id").to_pylist(), encoded(b, vocabulary, end_id), strict=True):
                frames.append(pack.compress(x.tobytes()))
                ids.append(doc_id)
                offsets.append(offsets[-1] + len(frames[-1]))
                tokens += len(x)
                if offsets[-1] >= BLOCK:
                    yield block()
                    seq, first, ids, offsets, frames = seq + 1, tokens, [], [0], []
        if ids:
            yield block()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(PARTS, size // PART + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    rows.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) of the files under ``path``; ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. ``only`` reads some
    documents: blocks are pruned by their range of ids, frames by the index.
    """
    held = spark.read.parquet(f"{path}/dictionary").first()
    raw, digest = bytes(held["dictionary"]), held["dict_hash"]
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError("the dictionary does not have its hash")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # Parts are as few as the writer's tasks, so their running total is one small window.
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = totals.select(F.col("part").alias("_part"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("_base"))
    wanted = None if only is None else frozenset(only)
    if wanted is not None:
        keep = F.lit(False)
        for x in sorted(wanted):
            keep = keep | ((F.col("min_id") <= x) & (F.col("max_id") >= x))
        blocks = blocks.filter(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=usable(raw))
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError(f"block {row['part']}/{row['seq']} needs dictionary {row['dict_hash']}")
                payload, at, out = row["payload"], row["first_token"], []
                for doc_id, lo, hi in zip(row["doc_ids"], row["offsets"], row["offsets"][1:], strict=False):
                    frame = payload[lo:hi]
                    if wanted is None or doc_id in wanted:
                        out.append((doc_id, row["part"], at, unpack.decompress(frame)))
                    # A frame's header has its content's size.
                    at += zstandard.frame_content_size(frame) // 4
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["doc_id", "part", "local_start", "ids"])

    rows = blocks.select("part", "first_token", "dict_hash", "doc_ids", "offsets", "payload").mapInArrow(run, "doc_id long, part int, local_start long, ids binary")
    # One row a writer's task: PARTS at most.
    return rows.join(F.broadcast(bases), F.col("part") == F.col("_part")).select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "ids")


def op6_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_path(spark, "token-ids")
    write_ids(docs, path)
    return read_ids(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
