"""Mixing sources to target weights under a time-varying curriculum (DataFrame functions only).

Every source has a weight schedule: a line from its weight at the start of
training to its weight at the end. The schedule's integral gives the source's
share of the token budget; a share is held to ``max_epochs`` times what the
source has, and what is cut goes to the others by weight (water filling, in
closed form). Within a source the documents stand in a fixed pseudo-random
order; the cumulative demand D(t) of the source is inverted at each document's
cumulative words to give its training position t in 0..1, and the rows are
range-sorted by position.

Cumulative words are computed in two levels, source x slice of the hash order
and then within the slice, so that a source with a third of all rows is dealt
out over ``SLICES`` groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.llm.common import WORD

#: Slices of each source's order (powers of two up to 4096).
SLICES = 1024
#: Relative tilt of the schedules, by turns: falling, level, rising. Their mean over training is 1.
TILTS = (0.5, 0.0, -0.5)


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """One row per source: source, source_size, weight, tilt, target.

    Sources by code point, null last, take ``weights`` and ``tilts`` by turns.
    The schedule w(t) = weight * (1 + tilt * (1 - 2t)) integrates to ``weight``.
    target = min(max_epochs * size, level * weight) with the level at which the
    targets add up to ``budget`` times all sizes. The windows without a key run
    over the summary, one row per source.
    """
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (F.pmod(F.col("_k") - 1, F.lit(len(xs))) + 1).cast("int"))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    by_source = by_source.withColumns({"weight": pick(weights), "tilt": pick(tilts), "_cap": F.col("source_size") * F.lit(float(max_epochs))})
    order = W.orderBy(F.col("_cap") / F.col("weight"), "_k")
    through, whole = order.rowsBetween(W.unboundedPreceding, 0), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = by_source.withColumns({"_caps": F.sum("_cap").over(through), "_w": F.sum("weight").over(through), "_all_w": F.sum("weight").over(whole), "_goal": F.sum("source_size").over(whole) * F.lit(float(budget))})
    # The level when the sources up to this one are capped and the others are not; the right one is the first that caps no more.
    filled = filled.withColumn("_level", (F.col("_goal") - (F.col("_caps") - F.col("_cap"))) / (F.col("_all_w") - (F.col("_w") - F.col("weight"))))
    filled = filled.withColumn("_open", F.col("_level") * F.col("weight") <= F.col("_cap"))
    filled = filled.withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), F.col("_k"), F.col("_level")))).over(whole)["_level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_final"), F.lit(float("inf"))) * F.col("weight"))
    return filled.select("source", "source_size", "weight", "tilt", F.round(target, 6).alias("target"))


def position_of(share: Column, tilt: Column) -> Column:
    """t at which a schedule 1 + tilt * (1 - 2t) has spent ``share`` of its integral: (1 + tilt) t - tilt t^2 = share."""
    root = F.sqrt(F.greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, F.lit(0.0)))
    return F.when(tilt == 0, share).otherwise((1 + tilt - root) / (2 * tilt))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2, tilts: tuple[float, ...] = TILTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, position, and ``takes``.

    ``takes`` lists the copies in the mix: pass, words and position of each; the
    copy at the target's edge may be cut. ``position`` is the first copy's; a
    row that the mix leaves out gets 1 + how far it is beyond the target, so
    that the sort stays even. A null text is size 0, a null source is a source
    of its own and the last; equal doc_ids are ordered by size, and rows equal
    in both count as repeated rows whose order does not matter. Texts are counted
    whole, however long. An empty table gives no rows. Other columns of ``docs``
    are not read, but for those in ``carry``, which the result has as well.
    """
    sized = docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = sized.withColumn("_h", digest).withColumn("_slice", F.floor(F.conv(F.substring("_h", 1, 3), 16, 10).cast("int") * F.lit(SLICES) / 4096).cast("int"))
    targets = source_targets(sized, weights, budget, max_epochs, tilts)
    slices = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_words"))
    before = slices.withColumn("_before", F.sum("_words").over(W.partitionBy("source").orderBy("_slice")) - F.col("_words"))
    before = before.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_words")
    # The source without nulls, so that the join needs no other partitioning than the window.
    known, name = F.col("source").isNotNull().alias("_known"), F.coalesce("source", F.lit("")).alias("_name")
    before = before.select(known, name, "_slice", "_before", "source_size", "target", "tilt")
    inner = W.partitionBy("_known", "_name", "_slice").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = sized.select("*", known, name).withColumn("_in", F.sum("size").over(inner) - F.col("size")).join(before, ["_known", "_name", "_slice"])
    rows = rows.withColumn("_start", F.col("_before") + F.col("_in"))
    take = lambda p: F.least(F.greatest(F.round(F.col("target")).cast("long") - p * F.col("source_size") - F.col("_start"), F.lit(0)), F.col("size"))
    at = lambda p: position_of(F.coalesce((p * F.col("source_size") + F.col("_start")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0)), F.col("tilt"))
    passes = range(max_epochs)
    taken = sum((take(p) for p in passes), F.lit(0).cast("long"))
    left_out = 1 + F.coalesce((F.col("_start") - F.col("target")) / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    takes = F.filter(F.array(*[F.struct(F.lit(p).alias("pass"), take(p).alias("words"), F.least(at(p), F.lit(1.0)).alias("position")) for p in passes]), lambda x: x["words"] > 0)
    rows = rows.withColumns({"taken": taken, "takes": takes})
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, F.col("takes")[0]["position"]).otherwise(left_out))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "takes", *carry)


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: a row of ``docs`` for each time it is taken, columns as they were, range-sorted by training position.

    The copy at a target's edge is in whole or out, whichever is nearer; a row of
    size 0 is never taken. Each row, repeated ones too, travels through ``mix``
    with its own takes, whatever its columns are called; texts of any length go
    whole. Nulls, ties and empty tables are as in ``mix``.
    """
    kept = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")
    takes = mix(kept, carry=("row",), **params).select("row", "doc_id", "size", F.explode("takes").alias("take")).filter(F.col("take.words") * 2 >= F.col("size"))
    return takes.orderBy("take.position", "doc_id").select("row.*")


def mix_sorted(docs: DataFrame, **params) -> DataFrame:
    """``mix`` range-sorted by training position."""
    return mix(docs, **params).orderBy("position", "doc_id")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sorted(docs).select("doc_id", "size", "source_size", "target", "taken", "source", (F.round("position", 9) + 0.0).alias("position"))


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    CASE (k - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS tilt, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM weighted WINDOW o AS (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING)),
targets AS (
  SELECT source, source_size, tilt, round(least(cap, w * coalesce((SELECT level FROM levels WHERE level * w <= cap ORDER BY cap / w, k LIMIT 1), 'inf'::DOUBLE)), 6) AS target
  FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.tilt, t.target,
    sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, least(greatest(CAST(round(target) AS BIGINT) - start, 0), size) AS a,
    least(greatest(CAST(round(target) AS BIGINT) - source_size - start, 0), size) AS b,
    coalesce(start / nullif(target, 0), 0) AS u, coalesce((source_size + start) / nullif(target, 0), 0) AS v FROM placed),
inverted AS (
  SELECT *, CASE WHEN a > 0 THEN u ELSE v END AS share FROM cut)
SELECT doc_id, size, source_size, target, CAST(a + b AS BIGINT) AS taken, source,
  round(CASE WHEN a + b = 0 THEN 1 + coalesce((start - target) / nullif(source_size, 0), 0)
    ELSE least(CASE WHEN tilt = 0 THEN share
      ELSE (1 + tilt - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, 0))) / (2 * tilt) END, 1) END, 9) + 0.0::DOUBLE AS position
FROM inverted
"""
