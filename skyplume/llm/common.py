"""What the corpus operators share: the shared folder, checkpoints, components, tiles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deletes these to compare texts; separates words elsewhere.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing and everything runs on one machine, as in
    tests, a temporary folder is taken and kept for the session; on a cluster
    there is no such folder and that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skyplume-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/skyplume/{label}-{uuid.uuid4().hex}"


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to ``rows``, so that a Python worker holds few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of each finished job are removed; what jobs leave is checkpointed or written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and its path."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that ``written`` made, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Gives a folder another name."""
    where, there = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(there.getParent())
    if not files.rename(where, there):
        raise OSError(f"{path} could not become {to}")


def seeded(seed: int, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), key)


def numbered(rows: DataFrame, key: str, name: str, hashed: Callable[[int, Column], Column] = seeded, rounds: int = 50) -> DataFrame:
    """``rows``, each with a ``key`` of its own, and a number for it under ``name``: no two keys have the same, and reruns give the same.

    Numbers are hashes of 64 bits; the few keys whose numbers meet are hashed anew
    until none do.
    """
    out = settled(rows.withColumn(name, hashed(0, F.col(key))))
    for seed in range(1, rounds):
        clash = settled(out.groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(name).alias("_clash")))
        if clash.isEmpty():
            return out
        out = settled(out.join(clash, F.col(name) == F.col("_clash"), "left").withColumn(name, F.when(F.col("_clash").isNotNull(), hashed(seed, F.col(key))).otherwise(F.col(name))).drop("_clash"))
    raise RuntimeError(f"numbers still meet after {rounds} rounds")


def min_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n nodes, each one's smallest node index that the links reach."""
    label = np.arange(n)
    while len(left):
        left, right = label[left], label[right]
        open_ = left != right
        left, right = left[open_], right[open_]
        low = np.minimum(left, right)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b): component is the smallest node reachable.

    Alternating large and small stars: each round points every node at the
    smallest of its neighbours, so paths shorten by a constant factor. Minima
    are combined before the shuffle; the joins can be split where a hub is hot.
    Null ends and loops are ignored.
    """
    edges = settled(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = settled(near.filter("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def tiled(rows: DataFrame, keys: list[str], home: str, ident: str, block: int) -> DataFrame:
    """Deals each key's comparisons (home rows against all rows) into tiles of bounded size.

    Adds ``hb``, ``mb`` (the tile) and ``role``: 1 the row is a home row of the
    tile, 2 a member, 3 both. A key of up to ``block`` rows is one tile; a hot
    key is cut into blocks of about ``block`` rows, and each home block meets
    each member block once, so no comparison is lost and no task gets a whole
    hot key.
    """
    hot = settled(rows.groupBy(*keys).agg(F.count_if(home).alias("_nh"), F.count("*").alias("_nm")).filter(F.col("_nm") > block))
    n_hot = hot.count()
    if n_hot == 0:
        return rows.withColumns({"hb": F.lit(0), "mb": F.lit(0), "role": F.when(F.col(home), 3).otherwise(2)})
    # The hot keys are few; only a checked number of them is broadcast.
    side = F.broadcast(hot) if n_hot <= 50_000 else hot
    h = F.pmod(F.xxhash64(ident), F.lit(1 << 30))
    out = rows.join(side, keys, "left").withColumns({"_nhb": F.ceil(F.coalesce(F.col("_nh"), F.lit(1)) / block).cast("int"), "_nmb": F.ceil(F.coalesce(F.col("_nm"), F.lit(1)) / block).cast("int"), "_h": h})
    out = out.withColumn("_nhb", F.greatest("_nhb", F.lit(1)))
    tile = lambda i, j, role: F.struct(i.cast("int").alias("hb"), j.cast("int").alias("mb"), F.lit(role).alias("role"))
    as_home = F.transform(F.sequence(F.lit(0), F.col("_nmb") - 1), lambda j: tile(F.pmod(F.col("_h"), F.col("_nhb")), j, 1))
    as_member = F.transform(F.sequence(F.lit(0), F.col("_nhb") - 1), lambda i: tile(i, F.pmod(F.col("_h"), F.col("_nmb")), 2))
    one = F.array(F.struct(F.lit(0).alias("hb"), F.lit(0).alias("mb"), F.when(F.col(home), 3).otherwise(2).alias("role")))
    deals = F.when(F.col("_nm").isNull(), one).when(F.col(home), F.concat(as_home, as_member)).otherwise(as_member)
    return out.withColumn("_t", F.explode(deals)).select(*rows.columns, "_t.hb", "_t.mb", "_t.role")

