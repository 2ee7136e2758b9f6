"""From when to when a wind is established, by several criteria, and what it is meanwhile.

Times are whole numbers of one unit, ``per_second`` of them a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions import circular as C
from skyplume.functions.guards import finite
from skyplume.operators import series
from skyplume.operators.quantiles import quantiles
from skyplume.sources.folder import settled


def steadied(value: str, size: int, keys: list[str], at: str) -> Column:
    """Moving mean of ``size`` rows; a key with fewer rows stays as it is."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return F.when(n >= size, series.edge_mean(F.col(value), size, keys, [at])).otherwise(F.col(value))


def established(
    flow: DataFrame, keys: list[str], at: str, side: float, hull: DataFrame | None = None, per_second: int = 1000, rise: float = 0.30, turn: float = 5.0, hold: float = 2.0, texture: float = 0.30, margin: float = 0.10, cut: float = 0.02, hold_edge: float = 0.5, smooth: int = 9
) -> DataFrame:
    """(keys, start, stop, rise_at, turn_at, texture_at, edge_at, degenerate) of each key of ``flow`` (keys, at, angle, texture, edge_distance, cut).

    It starts at the later of two moments: when the column stops rising (|up| over
    speed in ``hull`` (keys, at, up, speed) stays below ``rise``) and when the direction stops
    turning (below ``turn`` degrees a second), each for ``hold`` seconds; without either,
    at the first row. It ends at the earlier of two: when the texture stays below
    ``texture``, and when the front nears the border (distance below ``margin`` of ``side``
    pixels, or a share above ``cut`` on it) for ``hold_edge`` seconds; else at the last
    row. An end that is not after the start is degenerate, and the last row is taken.
    """
    span = lambda s: int(s * per_second)
    rows = series.unwrap(flow, "angle", keys, [at])
    rows = rows.withColumn("_turn", F.abs(series.rate("unwrapped", at, keys, [at])) * per_second)
    rows = rows.withColumns({"_texture": steadied("texture", smooth, keys, at), "_edge": steadied("edge_distance", smooth, keys, at)})
    # All moments in one order of each key's rows, and one row a key at the end.
    key = W.partitionBy(*keys)
    rows = rows.withColumn("_turned", series.sustained("_turn", turn, at, span(hold), keys))
    if hull is None:
        rows = rows.withColumn("rise_at", F.lit(None).cast(flow.schema[at].dataType))
    else:
        lift = hull.withColumn("_rise", F.abs(finite(F.col("up"))) / F.greatest(finite(F.col("speed")), F.lit(1e-6)))
        rows = rows.join(series.first_sustained(lift, "_rise", rise, at, span(hold), keys).withColumnRenamed("first_at", "rise_at"), keys, "left")
    rows = rows.withColumns({"turn_at": F.min(F.when(F.col("_turned"), F.col(at))).over(key), "_first": F.min(at).over(key), "_last": F.max(at).over(key)})
    rows = rows.withColumn("start", F.coalesce(F.greatest("turn_at", "rise_at"), "_first"))
    tests = (("texture_at", "_texture", texture, hold, "below"), ("_near", "_edge", margin * side, hold_edge, "below"), ("_over", "cut", cut, hold_edge, "above"))
    rows = rows.withColumns({name: series.sustained(value, bound, at, span(hold_), keys, sense) & F.coalesce(F.col(at) >= F.col("start"), F.lit(True)) for name, value, bound, hold_, sense in tests})
    found = rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("start", "_first", "_last", "rise_at", "turn_at")], *[F.min(F.when(F.col(c), F.col(at))).alias(c) for c, *_ in tests])
    found = found.withColumn("edge_at", F.least("_near", "_over")).withColumn("_stop", F.coalesce(F.least("texture_at", "edge_at"), "_last"))
    degenerate = F.col("_stop") <= F.col("start")
    return found.select(*keys, "start", F.when(degenerate, F.col("_last")).otherwise(F.col("_stop")).alias("stop"), "rise_at", "turn_at", "texture_at", "edge_at", degenerate.alias("degenerate"))


def summarised(flow: DataFrame, keys: list[str], at: str, windows: DataFrame) -> DataFrame:
    """(keys, n, toward, comes_from, spread, mean, middle, slowest, fastest) of the rows of ``flow`` (keys, at, azimuth, speed) within each key's window (keys, start, stop), directions weighted by speed; keys without rows there are left out."""
    rows = flow.join(windows.select(*keys, "start", "stop"), keys).filter((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("stop")))
    # Counted, summed up and ordered: found once.
    rows = settled(rows.select(*keys, finite(F.col("azimuth")).alias("_a"), finite(F.col("speed")).alias("_v")).dropna(subset=["_a", "_v"]))
    toward = C.circular_mean(F.col("_a"), F.col("_v"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), toward.alias("toward"), C.circular_spread(F.col("_a"), F.col("_v")).alias("spread"), F.avg("_v").alias("mean"), F.min("_v").alias("slowest"), F.max("_v").alias("fastest"))
    middle = quantiles(rows, keys, F.col("_v"), [0.5], ["middle"])
    return out.join(middle, keys).select(*keys, "n", "toward", F.pmod(F.col("toward") + 180, F.lit(360.0)).alias("comes_from"), "spread", "mean", "middle", "slowest", "fastest")
