"""Histograms of angles and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyplume.functions.guards import finite


def circular_counts(df: DataFrame, keys: list[str], angle: Column, bins: int) -> DataFrame:
    """(keys, bin, n) of the bins that have rows; the last bin takes 360."""
    a = F.pmod(finite(angle), F.lit(360.0))
    return df.select(*keys, F.least(F.floor(a * bins / 360.0).cast("int"), F.lit(bins - 1)).alias("bin")).filter("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def circular_density(df: DataFrame, keys: list[str], angle: Column, bins: int) -> DataFrame:
    """(keys, density): one value a bin, per radian, empty bins 0; a key's bins come together, its rows don't."""
    counts = circular_counts(df, keys, angle, bins)
    held = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"), F.sum("n").alias("_all"))
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("_m")[b], F.lit(0)) / F.col("_all") / F.radians(F.lit(360.0 / bins)))
    return held.select(*keys, each.alias("density"))


def circular_modes(df: DataFrame, keys: list[str], angle: Column, bins: int, most: int) -> DataFrame:
    """(keys, bin, n, mode): up to ``most`` local maxima of the ring of bins (above the bin before, not below the one after), the highest first."""
    held = circular_counts(df, keys, angle, bins).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    at = lambda b: F.coalesce(F.col("_m")[b % bins], F.lit(0))
    ring = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct((-at(b)).alias("m"), b.alias("bin"), at(b + bins - 1).alias("l"), at(b + 1).alias("r")))
    tops = F.slice(F.sort_array(F.filter(ring, lambda x: (-x["m"] > x["l"]) & (-x["m"] >= x["r"]))), 1, most)
    return held.select(*keys, F.posexplode(tops).alias("_k", "t")).select(*keys, F.col("t.bin").alias("bin"), (-F.col("t.m")).alias("n"), (F.col("_k") + 1).cast("long").alias("mode"))
