"""Ordered analytics over keyed series.

Every function takes the key columns to partition by, so that no series
operation runs in one task, and the columns that give a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions import circular as C
from skyplume.functions.guards import above, below, finite, is_finite


def _ordered(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order)


def edge_mean(value: Column, size: int, keys: list[str], order: list[str]) -> Column:
    """Centred moving mean of odd ``size``; beyond the ends the first and last values are repeated.

    A key with fewer rows than ``size`` takes its own number of rows as the
    size; an even size reaches one row further back than ahead.
    """
    half, w = size // 2, _ordered(keys, order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, i = F.count(F.lit(1)).over(W.partitionBy(*keys)), F.row_number().over(w)
    left = F.greatest(F.lit(half + 1) - i, F.lit(0))
    right = F.greatest(F.lit(half) + i - n, F.lit(0))
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    full = (F.sum(value).over(w.rowsBetween(-half, half)) + first * left + last * right) / size
    # Fewer rows than ``size``: all of them, each as often as clamped places fall on it.
    back = F.floor(n / 2)
    short = F.sum(value).over(w.rowsBetween(-(size - 1), size - 1)) - _beyond(value, w, n, i, back, size) + first * F.greatest(back + 1 - i, F.lit(0)) + last * F.greatest(i - 1 - back, F.lit(0))
    return F.when(n >= size, full).otherwise(short / n)


def _beyond(value: Column, w, n: Column, i: Column, back: Column, size: int) -> Column:
    """Sum of a short key's values that lie outside the ``n`` places around row ``i``."""
    near = F.collect_list(value).over(w.rowsBetween(-(size - 1), size - 1))
    low, high = i - back, i - back + n - 1  # places from 1
    outside = F.filter(F.transform(near, lambda x, k: F.when(((k + 1) >= low) & ((k + 1) <= high), F.lit(0.0)).otherwise(x)), lambda x: x.isNotNull())
    return F.aggregate(outside, F.lit(0.0), lambda acc, x: acc + x)


def edge_circular_mean(angle: Column, size: int, keys: list[str], order: list[str]) -> Column:
    return C.angle_of(edge_mean(C.sin_deg(angle), size, keys, order), edge_mean(C.cos_deg(angle), size, keys, order))


def edge_median(value: Column, size: int, keys: list[str], order: list[str]) -> Column:
    """Centred moving median of odd ``size``, edges repeated."""
    half, w = size // 2, _ordered(keys, order)
    near = F.collect_list(value).over(w.rowsBetween(-half, half))
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    left = F.greatest(F.lit(half + 1) - F.row_number().over(w), F.lit(0)).cast("int")
    right = F.greatest(F.lit(half) + F.row_number().over(w) - n, F.lit(0)).cast("int")
    full = F.concat(F.array_repeat(near[0], left), near, F.array_repeat(F.element_at(near, -1), right))
    return F.sort_array(full)[half]


def fill_linear(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Adds ``filled``: ``y``, gaps (null, NaN or infinite) interpolated linearly over ``x``, the ends held."""
    w = W.partitionBy(*keys).orderBy(x)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(is_finite(F.col(y)), F.struct(F.col(x).alias("x"), finite(F.col(y)).alias("y")))
    df = df.withColumns({"_p": F.last(known, ignorenulls=True).over(back), "_n": F.first(known, ignorenulls=True).over(ahead)})
    share = (F.col(x) - F.col("_p.x")) / F.nullif(F.col("_n.x") - F.col("_p.x"), F.lit(0))
    between = F.col("_p.y") + F.coalesce(share, F.lit(0.0)) * (F.col("_n.y") - F.col("_p.y"))
    return df.withColumn("filled", F.coalesce(between, F.col("_p.y"), F.col("_n.y"))).drop("_p", "_n")


def sustained(value: str, threshold: float, at: str, span: int, keys: list[str], sense: str = "below") -> Column:
    """Whether ``value`` is below or above ``threshold`` from a row on for all rows within ``span``, two rows at least."""
    ahead = W.partitionBy(*keys).orderBy(at).rangeBetween(0, span)
    ok = below(F.col(value), threshold) if sense == "below" else above(F.col(value), threshold)
    return F.bool_and(ok).over(ahead) & (F.count(F.lit(1)).over(ahead) >= 2) & is_finite(F.col(value))


def first_sustained(df: DataFrame, value: str, threshold: float, at: str, span: int, keys: list[str], sense: str = "below", since: Column | None = None) -> DataFrame:
    """Per key, the first ``at`` (not before ``since``) from which ``value`` is below or above ``threshold`` for all rows within ``span``, two rows at least; null: never.

    A null or NaN is neither below nor above, and the first value is finite.
    """
    rows = df.withColumn("_all", sustained(value, threshold, at, span, keys, sense))
    if since is not None:
        rows = rows.withColumn("_all", F.col("_all") & F.coalesce(F.col(at) >= since, F.lit(True)))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("_all"), F.col(at))).alias("first_at"))


def longest_run(df: DataFrame, ok: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Per key, the longest run of rows where ``ok`` holds: start and end by ``order[0]``, and its rows; the first of equals."""
    w = _ordered(keys, order)
    rows = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    at = order[0]
    runs = rows.filter("_ok").groupBy(*keys, "_island").agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("stop"))
    best = F.max_by(F.struct("start", "stop", "n"), F.struct("n", -F.col("_island")))
    return runs.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.start").alias("run_start"), F.col("_b.stop").alias("run_stop"), F.col("_b.n").alias("run_rows"))


def episodes(df: DataFrame, index: str, level: str, threshold: float, gap: int, keys: list[str]) -> DataFrame:
    """Sessions of rows above ``threshold`` that lie at most ``gap`` rows apart.

    Kept if they span three rows or peak above twice the threshold; ``strength``
    sums level - threshold over all rows within, those below included, rows without
    a finite level left out. The sum is a difference of running totals, so nothing
    is joined back.
    """
    w = W.partitionBy(*keys).orderBy(index)
    rows = df.withColumn("_run", F.sum(F.coalesce(finite(F.col(level)), F.lit(float(threshold))) - threshold).over(w.rowsBetween(W.unboundedPreceding, 0)))
    hot = rows.filter(above(F.col(level), threshold) & is_finite(F.col(level)))
    hot = hot.withColumn("_new", F.when(F.col(index) - F.lag(index).over(w) > gap, 1).otherwise(0))
    hot = hot.withColumn("_id", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = hot.groupBy(*keys, "_id").agg(
        F.min(index).alias("first_row"), F.max(index).alias("last_row"), F.max(level).alias("peak"),
        (F.max_by("_run", index) - F.min_by(F.col("_run") - F.col(level) + threshold, index)).alias("strength"),
    )
    return found.filter((F.col("last_row") - F.col("first_row") >= 2) | (F.col("peak") > 2 * threshold)).drop("_id")


def quiet_window(df: DataFrame, index: str, level: str, length: int, tolerance: float, keys: list[str]) -> DataFrame:
    """Per key, the last start whose ``length`` rows stay within ``tolerance``, else the start of the lowest maximum."""
    w = W.partitionBy(*keys).orderBy(index)
    ahead = w.rowsBetween(0, length - 1)
    rows = df.withColumns({"_max": F.max(level).over(ahead), "_n": F.count(F.lit(1)).over(ahead)}).filter(F.col("_n") == length)
    calm = F.max(F.when(F.col("_max") <= tolerance, F.col(index)))
    return rows.groupBy(*keys).agg(F.coalesce(calm, F.min_by(index, F.struct("_max", index))).alias("start_row"), calm.isNotNull().alias("is_calm"))


def unwrap(df: DataFrame, angle: str, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``unwrapped``: the angle followed beyond 360, the first plus all signed steps."""
    w = _ordered(keys, order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_step", F.coalesce(C.difference(F.col(angle), F.lag(angle).over(w)), F.lit(0.0)))
    return df.withColumn("unwrapped", F.first(angle).over(so_far) + F.sum("_step").over(so_far)).drop("_step")


def gradient(value: str, keys: list[str], order: list[str]) -> Column:
    """Central differences by row, one-sided at the ends; null for a single row."""
    w = _ordered(keys, order)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.coalesce((after - before) / 2, after - here, here - before)


def rate(value: str, at: str, keys: list[str], order: list[str]) -> Column:
    """Change of ``value`` per ``at``: the quotient of their differences by row."""
    return gradient(value, keys, order) / F.nullif(gradient(at, keys, order), F.lit(0))


def running_path(step: Column, keys: list[str], order: list[str]) -> Column:
    """Running total of ``step``, 0 at the first row."""
    w = _ordered(keys, order)
    return F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.first(step).over(w.rowsBetween(W.unboundedPreceding, 0))


def local_maxima(value: str, reach: int, keys: list[str], order: list[str]) -> Column:
    """True where ``value`` is above all rows within ``reach``; rows with fewer neighbours don't count."""
    w = _ordered(keys, order)
    others = [f(value, k).over(w) for k in range(1, reach + 1) for f in (F.lag, F.lead)]
    out = F.lit(True)
    for o in others:
        out = out & (F.col(value) > o)
    return F.coalesce(out, F.lit(False))


def even_rows(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Up to ``n`` rows of each key at evenly spaced, half-even rounded places, the first and last among them."""
    w = _ordered(keys, order)
    rows = df.withColumns({"_r": F.row_number().over(w) - 1, "_m": F.count(F.lit(1)).over(W.partitionBy(*keys))})
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (F.col("_m") - 1) / F.lit(float(n - 1))).cast("int"))
    return rows.filter((F.col("_m") <= n) | F.array_contains(places, F.col("_r").cast("int"))).drop("_r", "_m")


def repeats(frame: str, keys: list[str], fps_in: float, fps_out: float, speed: float = 1.0) -> Column:
    """How often each row is shown so that gaps between frames keep their time: the way to the next row, for the last row from the one before, 1 for a row alone."""
    w = _ordered(keys, [frame])
    gap = F.coalesce(F.lead(frame).over(w) - F.col(frame), F.col(frame) - F.lag(frame).over(w), F.lit(1))
    return F.greatest(F.rint(gap / max(fps_in, 1e-6) / max(speed, 1e-6) * fps_out).cast("long"), F.lit(1))


def gap_reasons(df: DataFrame, frame: str, pixels: str, readable: Column, max_gap: int, least: int, keys: list[str]) -> DataFrame:
    """Adds ``reason`` to each row after a key's first: 'gap', 'unreadable', 'few pixels' or 'ok', the first that holds."""
    gap = F.col(frame) - F.lag(frame).over(_ordered(keys, [frame]))
    reason = F.when(gap > max_gap, "gap").when(~F.coalesce(readable, F.lit(False)), "unreadable").when(F.coalesce(F.col(pixels) <= least, F.lit(True)), "few pixels").otherwise("ok")
    return df.withColumns({"gap": gap, "reason": reason}).filter("gap is not null")


def first_reaching(df: DataFrame, index: str, value: str, share: float, keys: list[str]) -> DataFrame:
    """Per key, the first ``index`` whose finite ``value`` is ``share`` of the key's largest or more."""
    x = finite(F.col(value))
    top = df.groupBy(*keys).agg(F.max(x).alias("_top"))
    return df.join(top, keys).filter(x >= share * F.col("_top")).groupBy(*keys).agg(F.min(index).alias("first_index"))


def held_ends(df: DataFrame, t: str, value: str, keys: list[str]) -> DataFrame:
    """Adds ``estimate``: gaps inside interpolated, the last value held, and before the first a power law of t + 1 fitted to all values with t > 0."""
    y, x = finite(F.col(value)), F.ln(F.greatest(F.col(t).cast("double"), F.lit(0.0)) + 1)
    fit = df.groupBy(*keys).agg(*[f(F.when((F.col(t) > 0) & (y > 0), F.ln(y)), F.when((F.col(t) > 0) & (y > 0), x)).alias(n) for f, n in ((F.regr_slope, "_b"), (F.regr_intercept, "_a"))], F.min(F.when(y.isNotNull(), F.col(t))).alias("_first"))
    rows = fill_linear(df, t, value, keys).join(fit, keys)
    law = F.exp(F.col("_a") + F.col("_b") * x)
    return rows.withColumn("estimate", F.when(F.col(t) < F.col("_first"), law).otherwise(F.col("filled"))).drop("_a", "_b", "_first", "filled")


def drift(df: DataFrame, t: str, x: str, y: str, keys: list[str]) -> DataFrame:
    """Per key, speed and azimuth (degrees from north, clockwise) from the first to the last row, and the extents of x and y."""
    first, last = (lambda c: F.min_by(c, t)), (lambda c: F.max_by(c, t))
    dx, dy = last(x) - first(x), last(y) - first(y)
    dt = F.nullif(F.max(t) - F.min(t), F.lit(0))
    return df.groupBy(*keys).agg((F.sqrt(dx * dx + dy * dy) / dt).alias("speed"), F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)).alias("azimuth"), (F.max(x) - F.min(x)).alias("extent_x"), (F.max(y) - F.min(y)).alias("extent_y"))


def plateau(df: DataFrame, t: str, height: str, volume: str, keys: list[str], share_volume: float = 0.6, share_height: float = 0.9) -> DataFrame:
    """Per key, the height where it stops rising: median from the first full row that reaches ``share_height`` of the largest height.

    A row is full if its volume is ``share_volume`` of the largest or more; with
    fewer than three such rows all are.
    """
    key = W.partitionBy(*keys)
    rows = df.select(*keys, t, finite(F.col(height)).alias("_h"), finite(F.col(volume)).alias("_v"))
    rows = rows.withColumn("_big", F.coalesce(F.col("_v") >= share_volume * F.max("_v").over(key), F.lit(False)))
    rows = rows.withColumn("_n", F.count_if("_big").over(key)).filter("_big or _n < 3").withColumn("_top", F.max("_h").over(key))
    rows = rows.withColumn("_from", F.min(F.when(F.col("_h") >= share_height * F.col("_top"), F.col(t))).over(key)).filter(F.col(t) >= F.col("_from"))
    return rows.groupBy(*keys).agg(F.median("_h").alias("plateau"), F.min(t).alias("since"), F.count("*").alias("n_rows"), F.min("_h").alias("lowest"), F.max("_h").alias("highest"))


def band(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Lowest and highest finite ``value`` of each key over its replicas, and how many there are."""
    x = finite(F.col(value))
    return df.groupBy(*keys).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("replicas"))


def high_pass(df: DataFrame, keys: list[str], order: list[str], value: str, cutoff: float, rows: int = 500_000) -> DataFrame:
    """Adds ``passed``: a second-order Butterworth high-pass run forward and back, ``cutoff`` as a share of half the sampling rate.

    A key's series (a pixel over a clip) is filtered whole; keys are dealt out in
    blocks of some ``rows``, and all series of a block that are as long are filtered
    together, a moment at a time. Null and NaN count as 0. Ends are extended by odd
    reflection.
    """
    import numpy as np
    import pyarrow as pa

    from skyplume.operators.frames import passed_high

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("_key", *order)])
        first = np.flatnonzero(np.diff(np.concatenate(([-1], table.column("_key").combine_chunks().dictionary_encode().indices.to_numpy()))))
        size = np.diff(np.append(first, table.num_rows))
        x = np.nan_to_num(table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False))
        out = np.empty_like(x)
        for n in np.unique(size).tolist():
            at = first[size == n][None, :] + np.arange(n)[:, None]
            out[at] = passed_high(x[at], cutoff)
        return table.drop_columns(["_key", "_block"]).append_column("passed", pa.array(out))

    # Keys are told apart whole; the hash only deals them out.
    blocks = df.count() // rows + 1
    dealt = df.withColumns({"_key": F.to_json(F.struct(*keys)), "_block": F.pmod(F.xxhash64(*keys), F.lit(blocks))})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return dealt.groupBy("_block").applyInArrow(run, f"{fields}, passed double")
