"""Joins on time with a bounded reach, as equi-joins on time buckets.

A bounded inequality alone would plan as a nested loop; here one side is
replicated to the buckets that its reach touches and Spark shuffles on keys and
bucket, so that a hot key is dealt out over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions import circular as C
from skyplume.functions.guards import finite
from skyplume.operators.quantiles import quantiles


def bucketed(left: DataFrame, right: DataFrame, left_at: str, right_at: str, reach: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs with equal ``keys`` and |left_at - right_at| <= ``reach``; the two sides' other columns must not clash."""
    keys = keys or []
    a = left.withColumn("_bucket", F.floor(F.col(left_at) / reach))
    b = right.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(right_at) / reach) + d for d in (-1, 0, 1)])))
    return a.join(b, [*keys, "_bucket"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("_bucket")


def bracketed(queries: DataFrame, ident: str, at: str, series: DataFrame, series_at: str, value: str, max_gap: int, keys: list[str] | None = None, direction: str | None = None) -> DataFrame:
    """``value`` of ``series`` at each query by linear interpolation between its neighbours, and the direction by that of the unit vectors.

    The previous point is strictly before the query, the next one at it or after.
    ``status`` is 'ok'; 'before' or 'after' where the query lies at or before a
    key's first point or beyond its last; 'gap' where the neighbours are more
    than ``max_gap`` apart; 'none' where the key has no points. Queries are told
    apart by ``ident``. The ends of a key are one row each.

    Queries and points are lined up within buckets of ``max_gap``, so that each row
    is ordered once however dense the series is; what a bucket lacks at its edge
    comes from the ends of the buckets next to it.
    """
    keys = keys or []
    points = series.select(*keys, F.col(series_at).alias("_t"), F.col(value).alias("_v"), (F.col(direction) if direction else F.lit(None)).cast("double").alias("_d")).dropna(subset=["_t", *keys])
    bucket = lambda t: F.floor(t / max_gap)
    dots = points.select(*keys, F.col("_t").alias("_at"), F.lit(1).alias("_kind"), F.struct("_t", "_v", "_d").alias("_p"))
    asked = queries.select(*keys, F.col(at).alias("_at"), F.lit(0), F.lit(None).cast(dots.schema["_p"].dataType), F.col(ident).alias("_q"))
    line = dots.withColumn("_q", F.lit(None).cast(queries.schema[ident].dataType)).union(asked).withColumn("_b", bucket(F.col("_at")))
    order = W.partitionBy(*keys, "_b").orderBy("_at", "_kind", "_p")  # a query comes before the points of its time
    line = line.withColumns({"p": F.last("_p", True).over(order.rowsBetween(W.unboundedPreceding, 0)), "n": F.first("_p", True).over(order.rowsBetween(0, W.unboundedFollowing))}).filter("_kind = 0").drop("_at", "_kind", "_p")
    edges = dots.groupBy(*keys, bucket(F.col("_at")).alias("_b")).agg(F.max("_p").alias("_last"), F.min("_p").alias("_first"))
    for d, edge, side in ((1, "_last", "p"), (-1, "_first", "n")):
        line = line.join(edges.select(*keys, (F.col("_b") + d).alias("_b"), edge), [*keys, "_b"], "left").withColumn(side, F.coalesce(side, edge)).drop(edge)
    around = line.select("_q", "p", "n")
    ends = points.groupBy(*keys).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    rows = queries.join(around, F.col(ident) == F.col("_q"), "left").drop("_q")
    rows = rows.join(ends, keys, "left") if keys else rows.join(F.broadcast(ends), F.lit(True), "left")
    ok = F.coalesce(F.col("n._t") - F.col("p._t") <= max_gap, F.lit(False))
    status = F.when(F.col("_first").isNull(), "none").when(F.col(at) <= F.col("_first"), "before").when(F.col(at) > F.col("_last"), "after").when(ok, "ok").otherwise("gap")
    share = (F.col(at) - F.col("p._t")) / (F.col("n._t") - F.col("p._t"))
    mixed = lambda f: (1 - share) * f(F.col("p._d")) + share * f(F.col("n._d"))
    out = {"status": status, "interpolated": F.when(status == "ok", F.col("p._v") + share * (F.col("n._v") - F.col("p._v")))}
    if direction:
        out["direction"] = F.when(status == "ok", C.angle_of(mixed(C.sin_deg), mixed(C.cos_deg)))
    return rows.withColumns(out).drop("p", "n", "_first", "_last")


def coverage(series: DataFrame, keys: list[str], at: str, instants: list[int], margin: int, least: int) -> DataFrame:
    """Whether each key's series covers each of some ``instants``: (keys, instant, verdict, n_near, nearest).

    'before' or 'after' the series, 'hole' without a point within ``margin``,
    'partial' with fewer than ``least`` of them, else 'full'. One aggregation for
    all instants; a key without points has no row, one with null times only is
    'empty'.
    """
    t = F.col(at)
    each = [F.struct(F.lit(e).alias("instant"), F.count_if(F.abs(t - e) <= margin).alias("n"), F.min(F.abs(t - e)).alias("d")) for e in instants]
    rows = series.groupBy(*keys).agg(F.min(t).alias("_first"), F.max(t).alias("_last"), F.array(*each).alias("_e")).withColumn("_e", F.explode("_e"))
    e, n = F.col("_e.instant"), F.col("_e.n")
    verdict = F.when(F.col("_first").isNull(), "empty").when(e < F.col("_first"), "before").when(e > F.col("_last"), "after").when(n == 0, "hole").when(n < least, "partial").otherwise("full")
    return rows.select(*keys, e.alias("instant"), verdict.alias("verdict"), n.alias("n_near"), F.when(verdict.isin("partial", "full"), F.col("_e.d")).alias("nearest"))


def coverage_at(series: DataFrame, keys: list[str], at: str, instants: DataFrame, margin: int, least: int) -> DataFrame:
    """``coverage`` for a table of ``instants`` (keys, instant): each key's own, however many; a key without points is 'empty' here.

    Points and instants meet in buckets of ``margin``, and each key's ends are one row.
    """
    asked = instants.select(*keys, "instant").distinct()
    points = series.select(*keys, F.col(at).alias("_t"))
    ends = points.groupBy(*keys).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    near = bucketed(asked, points, "instant", "_t", margin, keys).groupBy(*keys, "instant").agg(F.count("*").alias("_n"), F.min(F.abs(F.col("_t") - F.col("instant"))).alias("_d"))
    rows = asked.join(ends, keys, "left").join(near, [*keys, "instant"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    e, n = F.col("instant"), F.col("_n")
    verdict = F.when(F.col("_first").isNull(), "empty").when(e < F.col("_first"), "before").when(e > F.col("_last"), "after").when(n == 0, "hole").when(n < least, "partial").otherwise("full")
    return rows.select(*keys, "instant", verdict.alias("verdict"), n.alias("n_near"), F.when(verdict.isin("partial", "full"), F.col("_d")).alias("nearest"))


def nearest(left: DataFrame, ident: str, left_at: str, right: DataFrame, right_id: str, right_at: str, tolerance: int, keys: list[str]) -> DataFrame:
    """(ident, right_id, distance): the nearest row of ``right`` within ``tolerance``; ties: the smaller right_id."""
    pairs = bucketed(left, right, left_at, right_at, tolerance, keys)
    best = F.min(F.struct(F.abs(F.col(left_at) - F.col(right_at)).alias("d"), F.col(right_id).alias("r"))).alias("_b")
    return pairs.groupBy(ident).agg(best).select(ident, F.col("_b.r").alias(right_id), F.col("_b.d").alias("distance"))


def in_all(df: DataFrame, keys: list[str], variant: str, n: int) -> DataFrame:
    """Keys that occur with ``n`` different values of ``variant``."""
    return df.groupBy(*keys).agg(F.countDistinct(variant).alias("_n")).filter(F.col("_n") == n).drop("_n")


def latest(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def first_known(base: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """``value`` from the first of ``sources`` (name, table) that has the key, and the source's name."""
    out, values, names = base, [], []
    for k, (name, table) in enumerate(sources):
        out = out.join(table.select(F.col(key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}")), F.col(key) == F.col(f"_k{k}"), "left")
        values.append(F.col(f"_v{k}"))
        names.append(F.when(F.col(f"_v{k}").isNotNull(), name))
    return out.select(*base.columns, F.coalesce(*values).alias(value), F.coalesce(*names).alias("origin"))


def left_default(left: DataFrame, right: DataFrame, keys: list[str], value: Column, default) -> DataFrame:
    """``left`` with ``value`` (named, over columns of ``right``) by key, ``default`` where it is missing."""
    name = "_default_value"
    rows = left.join(right.select(*keys, value, F.lit(True).alias(name)), keys, "left")
    fresh = [c for c in rows.columns if c not in left.columns and c != name]
    return rows.select(*left.columns, *[F.coalesce(c, F.lit(default)).alias(c) for c in fresh])


def confident_or_all(df: DataFrame, key: str, modes: DataFrame, mode: str, unsure: str, group: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``mode`` is known and not ``unsure``; of a group without any such row, all."""
    sure = F.coalesce(F.col("_mode") != unsure, F.lit(False))
    rows = df.join(modes.select(F.col(key).alias("_key"), F.col(mode).alias("_mode")), F.col(key) == F.col("_key"), "left").withColumn("_sure", sure)
    some = rows.groupBy(*group).agg(F.bool_or("_sure").alias("_some"))
    return rows.join(some, group).filter(F.col("_sure") | ~F.col("_some")).select(*df.columns)


def known_or_median(df: DataFrame, key: str, values: DataFrame, value: str, group: list[str]) -> DataFrame:
    """``df`` with ``value`` by key; where it is missing or not finite, the median of the group's finite ones."""
    rows = df.join(values.select(F.col(key).alias("_key"), finite(F.col(value)).alias("_v")), F.col(key) == F.col("_key"), "left")
    middle = quantiles(rows.select(*group, "_v"), group, F.col("_v"), [0.5], ["_median"])
    return rows.join(middle, group, "left").select(*df.columns, F.coalesce("_v", "_median").alias(value))


def known_or_frame_time(df: DataFrame, frame: str, times: DataFrame, t: str, start: float, fps: float) -> DataFrame:
    """``df`` with ``t`` by frame; where it is missing, from the frame's number."""
    rows = df.join(times.select(F.col(frame).alias("_key"), finite(F.col(t)).alias("_t")), F.col(frame) == F.col("_key"), "left")
    return rows.select(*df.columns, F.coalesce("_t", (F.col(frame) - start) / fps).alias(t))


def merged_origins(old: Column, new: Column, manual: str = "set by hand") -> Column:
    """Map of keys to origins: the new one, but an old origin stays where the new one is by hand and the old was not, or where there is no new one."""
    keep = lambda k, a, b: F.when(b.isNull(), a).when(a.isNotNull() & b.startswith(manual) & ~a.startswith(manual), a).otherwise(b)
    return F.map_zip_with(old, new, keep)


def preferred(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def last_file_wins(rows: DataFrame, keys: list[str], file: str, keep: list[str]) -> DataFrame:
    """One row a key over files that overlap: that of the last file by name."""
    return latest(rows, keys, [F.col(file)], keep)


def first_of_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """The different rows of ``columns``."""
    return df.select(*columns).dropDuplicates()
