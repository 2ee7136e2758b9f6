"""Rankings, summary rows, flags and gaps for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions.guards import finite


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, and their ``place`` from 1; at most k rows of a key leave a task."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= k)


def steadiest(df: DataFrame, keys: list[str], member: str, value: Column, least: int, k: int) -> DataFrame:
    """(keys, member, cv, place): the ``k`` first members of each key, those with fewer than ``least`` rows before the others, then by coefficient of variation."""
    x = finite(value)
    rows = df.groupBy(*keys, member).agg(F.count("*").alias("_n"), F.round(F.stddev_pop(x) / F.nullif(F.avg(x), F.lit(0.0)), 6).alias("cv"))
    return top_rows(rows, keys, [(F.col("_n") < least).desc(), F.col("cv").asc_nulls_last(), F.col(member)], k).select(*keys, member, "cv", "place")


def missing_months(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, month): months without a row between each key's first and last."""
    months = df.select(*keys, F.to_date(F.date_trunc("month", at)).alias("month")).distinct()
    every = months.groupBy(*keys).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month"))).alias("month"))
    return every.join(months, [*keys, "month"], "left_anti")


def range_verdict(df: DataFrame, keys: list[str], at: str, low: Column, high: Column) -> DataFrame:
    """(keys, verdict): whether a key's rows lie 'before' or 'after' a whole range, leave a 'hole', cover it in 'partial' or in 'full'; single instants are judged by ``joins.coverage`` and ``coverage_at``."""
    t = F.col(at)
    c = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"), F.count_if(t.between(low, high)).alias("_n"))
    verdict = F.when(F.col("_b") < low, "before").when(F.col("_a") > high, "after").when(F.col("_n") == 0, "hole").when((F.col("_a") > low) | (F.col("_b") < high), "partial").otherwise("full")
    return c.select(*keys, verdict.alias("verdict"))


def with_summary(df: DataFrame, name: str, values: list[Column], within: Column, title: str) -> DataFrame:
    """A row of aggregates for each ``name``, and one called ``title`` over the rows ``within`` only."""
    detail = df.groupBy(name).agg(*values)
    return detail.unionByName(df.filter(within).agg(*values).withColumn(name, F.lit(title)))


def flagged(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """``df`` with ``flags``, the names whose condition holds, joined; and ``grade``: ok, check (one or two) or doubtful. Names that begin with [i] only inform; a null condition does not hold."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())
    grave = F.size(F.filter(found, lambda x: ~x.startswith("[i]")))
    return df.withColumns({"flags": F.array_join(found, "; "), "grade": F.when(grave == 0, "ok").when(grave <= 2, "check").otherwise("doubtful")})


#: Ends of names that say a length is in native pixels.
NATIVE = ("_nat", "_native", "_nativo", "_4k")


def is_native(name: Column | None, size: Column, frame: float, ends: tuple[str, ...] = NATIVE) -> Column:
    """Whether a length is in native pixels: by its name's end, else if it reaches the working frame's size."""
    by_size = F.coalesce(size >= frame, F.lit(False))
    if name is None:
        return by_size
    told = F.lit(False)
    for e in ends:
        told = told | F.coalesce(name.endswith(e), F.lit(False))
    return told | by_size


def working_pixels(size: Column, native: Column, scale: float) -> Column:
    return F.when(native, size * scale).otherwise(size.cast("double"))


def fits(value: Column, low: float, high: float) -> Column:
    """True below ``low``, false above ``high``, unknown between."""
    return F.when(value < low, True).when(value > high, False)


def scaled_fields(df: DataFrame, ident: str, field: str, value: str, scales: dict) -> DataFrame:
    """Entity-attribute-value rows as columns: ``scales`` has each field's column name and what turns its sum to its unit."""
    wide = df.groupBy(ident).pivot(field, list(scales)).sum(value)
    return wide.select(ident, *[how(F.col(f"`{f}`")).alias(name) for f, (name, how) in scales.items()])


def top_level(levels: DataFrame, keys: list[str], level: str, n: str, share: str, least: int, at_least: float) -> DataFrame:
    """Per key, the highest level with ``least`` rows or more of which ``at_least`` hold; ``limited``: the level above it has no rows at all."""
    good = (F.col(n) >= least) & (F.col(share) >= at_least)
    g = levels.groupBy(*keys).agg(F.max(F.when(good, F.col(level))).alias("top"), F.collect_set(F.when(F.col(n) > 0, F.col(level))).alias("_known"), F.count("*").alias("levels"))
    return g.select(*keys, "top", "levels", (~F.array_contains("_known", F.col("top") + 1)).alias("limited"))


def block_change(px: DataFrame, keys: list[str], frame: str, place: list[str], value: Column, block: list[Column]) -> DataFrame:
    """(frame, peak, typical): largest and median change of a frame against the key's frame before, over means of blocks of pixels."""
    step = F.abs(value - F.lag(value).over(W.partitionBy(*keys, *place).orderBy(frame)))
    rows = px.select(frame, *[b.alias(f"_b{k}") for k, b in enumerate(block)], step.alias("_d")).filter("_d is not null")
    means = rows.groupBy(frame, *[f"_b{k}" for k in range(len(block))]).agg(F.avg("_d").alias("_m"))
    # A frame has a bounded number of blocks.
    return means.groupBy(frame).agg(F.max("_m").alias("peak"), F.median("_m").alias("typical"))
