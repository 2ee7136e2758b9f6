"""Shards by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions).

Every shard has ``VNODES`` points on the ring; a document hashes to a cell of
the ring, and the cell's owner is the first point clockwise. Loads are bytes
and bounded by (1 + ``SLACK``) times the mean: cells are offered in ring order,
and one that would overfill its shard continues clockwise to the next point
whose shard has room. A cell is a narrow slice of the hash range, so the fill
runs over ``CELLS`` sums whatever the number of documents; the rows only look
their cell up.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VNODES = 128
CELLS = 16384
SLACK = 0.002


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """Sorted (position in 0..2^32-1, shard); a shard's points do not depend on the other shards."""
    return sorted((int.from_bytes(hashlib.md5(f"shard-{s}/{v}".encode()).digest()[:4], "big"), s) for s in range(shards) for v in range(vnodes))


def fill(loads: list[tuple[int, int]], shards: int, cells: int = CELLS, slack: float = SLACK) -> dict[int, int]:
    """(cell, bytes) in any order -> cell: shard. Bounded by the number of cells."""
    points = ring(shards)
    places = [p for p, _ in points]
    bound = sum(b for _, b in loads) * (1 + slack) / shards
    held, out = [0] * shards, {}
    for cell, size in sorted(loads):
        at = bisect.bisect_left(places, (cell << 32) // cells)
        order = dict.fromkeys(points[(at + k) % len(points)][1] for k in range(len(points)))
        # A cell over the bound in any shard (one giant document) goes to the emptiest shard on its way.
        to = next((s for s in order if held[s] + size <= bound), None)
        to = min(order, key=lambda s: held[s]) if to is None else to
        held[to] += size
        out[cell] = to
    return out


def ring_hash(doc_id: Column, text_crc: Column) -> Column:
    """32-bit ring position, unsigned. Rows without an id are placed by their text."""
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text_crc.cast("string")))), F.lit(1 << 32))


def shard(docs: DataFrame, shards: int = 8, cells: int = CELLS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, ring, cell, shard, slot of every row of ``docs``.

    size is the text's UTF-8 bytes (null: none) plus 1. ``slot`` numbers a
    shard's rows from 0 in ring order: cells are numbered from their counts, rows
    within a cell by a window, so no task gets a whole shard. Rows equal in ring
    position are ordered by doc_id, crc and size; fully repeated rows get slots
    in any order. Texts of any length count whole. An empty table gives no rows.
    Other columns are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("ring", ring_hash(F.col("doc_id"), F.col("text_crc32"))).withColumn("cell", F.shiftright("ring", 32 - (cells.bit_length() - 1)).cast("int"))
    spark = docs.sparkSession
    # At most `cells` rows, whatever the input.
    sums = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    to = fill([(r["cell"], r["bytes"]) for r in sums], shards, cells, slack)
    counts, table = [0] * shards, []
    for cell, n in sorted((r["cell"], r["n"]) for r in sums):
        table.append((cell, to[cell], counts[to[cell]]))
        counts[to[cell]] += n
    placed = spark.createDataFrame(table, "cell int, shard int, _first long")
    inner = W.partitionBy("cell").orderBy("ring", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("_at", F.row_number().over(inner) - 1)
    # The table is bounded by the number of cells.
    return rows.join(F.broadcast(placed), "cell").withColumn("slot", F.col("_first") + F.col("_at")).drop("_first", "_at")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
