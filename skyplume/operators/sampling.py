"""Samples that come out the same at every run, from hashes instead of random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def without_replacement(df: DataFrame, keys: list[str], ident: list[str], most: int, seed: int = 0) -> DataFrame:
    """Up to ``most`` rows of each key, the first by a seeded hash of ``ident``: at most so many rows of a key are held anywhere."""
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in ident]).cast("binary"))
    w = W.partitionBy(*keys).orderBy(h, *ident)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def with_replacement(df: DataFrame, keys: list[str], order: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` draws (``draw`` from 0) from each key's rows numbered by ``order``: draw d takes the row whose number is a seeded hash of the key and d."""
    rows = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    draws = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"), "_n")
    draws = draws.withColumn("_i", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.col("_n")).cast("int")).drop("_n")
    return draws.join(rows, [*keys, "_i"]).drop("_i")


def strided(px: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th pixel of every ``step``-th row."""
    return px.filter((F.col("v") % step == 0) & (F.col("u") % step == 0))
