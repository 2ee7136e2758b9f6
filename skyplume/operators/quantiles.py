"""Exact quantiles of keys of any size.

``percentile`` holds every value of a key in one buffer, which is right for keys
of up to ``BOUND`` values. Of larger ones equal values are counted first, a sketch
cuts each key into slices, the slices' counts say which of them hold the wanted
ranks, and only those are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions.guards import finite
from skyplume.sources.folder import settled

#: Values of a key that are held in one buffer.
BOUND = 100_000
#: Values that a task orders.
DEAL = 1_000_000
#: Slices of a larger key: about one for each BOUND of its values, within these.
SLICES, MOST_SLICES = 64, 4096


def quantiles(df: DataFrame, keys: list[str], value: Column, qs: list[float], names: list[str], bound: int = BOUND) -> DataFrame:
    """Per key, the quantiles ``qs`` of the finite values, interpolated linearly between ranks, as ``names``.

    Keys without a finite value are left out; null keys are a key of their own.
    Keys are counted first, and those with more than ``bound`` values go the other way.
    """
    rows = df.select(*keys, finite(value).alias("_x")).filter("_x is not null")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = counts.agg(F.count_if(F.col("_n") > bound), F.max("_n"), F.sum("_n")).first()
    # Tasks by the number of values, so that what one holds does not grow with the table.
    tasks = (most[2] or 0) // DEAL + 1
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = rows.repartition(tasks, *keys)
    else:
        dealt = rows
    if not most[0]:
        return plain(dealt, keys, qs, names)
    side = settled(counts.filter(F.col("_n") > bound).select(*keys))
    side = F.broadcast(side) if most[0] <= 50_000 else side
    slices = min(MOST_SLICES, max(SLICES, most[1] // bound))
    return plain(_joined(dealt, side, keys, "left_anti"), keys, qs, names).union(sliced(_joined(rows, side, keys, "left_semi"), keys, F.col("_x"), qs, names, slices))


def plain(rows: DataFrame, keys: list[str], qs: list[float], names: list[str]) -> DataFrame:
    """Quantiles of ``_x`` with a buffer a key."""
    found = rows.groupBy(*keys).agg(F.percentile("_x", F.array(*[F.lit(float(q)) for q in qs])).alias("_q"))
    return found.select(*keys, *[F.col("_q")[k].alias(n) for k, n in enumerate(names)])


def sliced(df: DataFrame, keys: list[str], value: Column, qs: list[float], names: list[str], slices: int = SLICES) -> DataFrame:
    """``quantiles`` without a buffer a key."""
    counts = df.select(*keys, finite(value).alias("_x")).filter("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("_x", [k / slices for k in range(1, slices)], max(1000, 4 * slices)).alias("_cuts"))
    same = lambda a, b, on: _joined(a, b, on)
    cut = same(counts, cuts, keys).withColumn("_s", F.size(F.filter("_cuts", lambda c: c < F.col("_x")))).drop("_cuts")
    sums = cut.groupBy(*keys, "_s").agg(F.sum("_n").alias("_m"))
    key = W.partitionBy(*keys)
    # Up to ``slices`` rows a key.
    sums = sums.withColumns({"_before": F.sum("_m").over(key.orderBy("_s")) - F.col("_m"), "_all": F.sum("_m").over(key)})
    at = [F.lit(float(q)) * (F.col("_all") - 1) for q in qs]
    ranks = F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])
    wanted = sums.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))).filter(F.size("_ranks") > 0)
    rows = same(cut, wanted.select(*keys, "_s", "_before", "_all"), [*keys, "_s"])
    low = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_s").orderBy("_x")) - F.col("_n")
    rows = rows.withColumn("_low", low)
    pick = lambda r: F.max(F.when((r >= F.col("_low")) & (r < F.col("_low") + F.col("_n")), F.col("_x")))
    both = [(pick(F.floor(x)), pick(F.ceil(x)), F.max(x - F.floor(x))) for x in at]
    return rows.groupBy(*keys).agg(*[(a + (b - a) * f).alias(n) for (a, b, f), n in zip(both, names, strict=True)])


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null."""
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & a[c].eqNullSafe(b[f"_r_{c}"])
    return a.join(b, cond, how).drop(*[f"_r_{c}" for c in on])


def robust_noise(df: DataFrame, keys: list[str], value: Column, centre: str = "med", spread: str = "noise") -> DataFrame:
    """Per key, median and 1.4826 times the median distance from it."""
    med = quantiles(df.select(*keys, value.alias("_value")), keys, F.col("_value"), [0.5], [centre])
    apart = _joined(df.select(*keys, value.alias("_value")), med, keys)
    mad = quantiles(apart, keys, F.abs(F.col("_value") - F.col(centre)), [0.5], [spread])
    return _joined(med, mad.withColumn(spread, 1.4826 * F.col(spread)), keys)
