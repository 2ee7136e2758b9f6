"""Frames as grey levels: filters, photometry, alignment, scores, gates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions.guards import finite
from skyplume.jobs.geometry_jobs import PX_SQL
from skyplume.jobs.mask_jobs import all_pixels
from skyplume.jobs.registry import query, table
from skyplume.operators import images, series
from skyplume.sources.folder import settled

#: Grey levels.
GREY_SQL = f"SELECT frame, label, v, u, round(128 + value * 200, 6) AS value FROM ({PX_SQL})"
BACK_SQL = f"SELECT v, u, median(value) AS value FROM ({GREY_SQL}) GROUP BY ALL"


def grey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pixels(spark, sf_dir).withColumn("value", F.round(128 + F.col("value") * 200, 6))


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyplume.operators.quantiles import quantiles

    return quantiles(grey(spark, sf_dir), ["v", "u"], F.col("value"), [0.5], ["value"])


AROUND_SQL = f"SELECT p.frame, CAST(a.v AS INTEGER) AS v, CAST(b.u AS INTEGER) AS u, dv, du, p.value FROM range(8) a(v), range(8) b(u), range(-1, 2) c(dv), range(-1, 2) d(du), ({GREY_SQL}) p WHERE p.v = greatest(least(a.v + dv, 7), 0) AND p.u = greatest(least(b.u + du, 7), 0)"


@query("median_blur", f"SELECT frame, v, u, round(median(value), 6) AS value FROM ({AROUND_SQL}) GROUP BY ALL")
def median_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.blurred_median(grey(spark, sf_dir), 1, 8, 8).withColumn("value", F.round("value", 6))


@query("gaussian_blur", f"SELECT frame, v, u, round(sum(value * CASE abs(dv) + abs(du) WHEN 0 THEN 0.25 WHEN 1 THEN 0.125 ELSE 0.0625 END) + 1e-9::DOUBLE, 5) AS value FROM ({AROUND_SQL}) GROUP BY ALL")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = [[0.0625, 0.125, 0.0625], [0.125, 0.25, 0.125], [0.0625, 0.125, 0.0625]]
    return images.convolved(grey(spark, sf_dir), kernel, 8, 8).withColumn("value", F.round(F.col("value") + 1e-9, 5))


@query("edge_strength", f"SELECT frame, v, u, round(pow(sum(value * du * (2 - abs(dv))), 2) + pow(sum(value * dv * (2 - abs(du))), 2), 3) AS value FROM ({AROUND_SQL}) GROUP BY ALL")
def edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.edges(grey(spark, sf_dir), 8, 8).withColumn("value", F.round("value", 3))


FIT_SQL = f"""
WITH g AS ({GREY_SQL}), b AS ({BACK_SQL}), r AS (SELECT quantile_cont(value, 0.25) AS ra, quantile_cont(value, 0.75) AS rb FROM b),
q AS (SELECT frame, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM g GROUP BY 1),
f AS (SELECT frame, CASE WHEN b - a < 1e-3 THEN 1 ELSE least(greatest((rb - ra) / (b - a), 0.5), 2.0) END AS gain, a, ra FROM q, r), h AS (SELECT frame, gain, ra - gain * a AS off FROM f)"""


@query("photometric_fit", FIT_SQL + " SELECT frame, round(gain, 6) AS gain, round(off, 4) AS \"offset\" FROM h")
def photometric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = images.photometric_fit(grey(spark, sf_dir), background(spark, sf_dir))
    return fit.select("frame", F.round("gain", 6).alias("gain"), F.round("offset", 4).alias("offset"))


@query("novel_and_hot", FIT_SQL + ", n AS (SELECT g.frame, g.v, g.u, abs(gain * g.value + off - b.value) AS nov, g.value FROM g JOIN h ON g.frame = h.frame JOIN b ON b.v = g.v AND b.u = g.u) SELECT frame, v, u, round(nov + 1e-9::DOUBLE, 4) AS novelty FROM n WHERE value > 130 AND nov > 12")
def novel_and_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that are hot and unlike the background."""
    px, back = grey(spark, sf_dir).withColumn("heat", F.col("value")), settled(background(spark, sf_dir))
    rows = images.novelty(px, back, images.photometric_fit(px, back), ("heat",)).withColumnRenamed("value", "novelty")
    return rows.filter(images.candidates(F.col("heat"), F.col("novelty"), 130, 12)).select("frame", "v", "u", F.round(F.col("novelty") + 1e-9, 4).alias("novelty"))


SIGMOID_SQL = "1 / (1 + exp(least(greatest(-({p}::DOUBLE) * ({x} - {c}::DOUBLE), -60), 60)))"
SCORE_SQL = " + ".join(f"{w}::DOUBLE * {SIGMOID_SQL.format(p=p, x=x, c=c)}" for w, c, p, x in ((0.35, 80.0, -0.08, "value"), (0.25, 30.0, -0.10, "value / 3"), (0.20, 120.0, -0.06, "value / 2"), (0.20, 20.0, -0.12, "value / 5")))


@query("shadow_score", f"SELECT event_id, round({SCORE_SQL}, 6) AS score FROM events")
def shadow_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much speaks for shadow."""
    v = F.col("value")
    score = images.shadow_score({"dark": v, "saturation": v / 3, "red": v / 2, "edges": v / 5})
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"))


@query(
    "frame_shifts",
    f"""
WITH g AS ({GREY_SQL}), b AS ({BACK_SQL}),
c AS (SELECT g.frame, dv, du, round(corr(g.value, b.value), 9) AS c FROM g, range(-1, 2) x(dv), range(-1, 2) y(du), b WHERE b.v = g.v + dv AND b.u = g.u + du GROUP BY ALL)
SELECT frame, CAST(dv AS INTEGER) AS dv, CAST(du AS INTEGER) AS du, round(c, 6) AS correlation FROM c QUALIFY row_number() OVER (PARTITION BY frame ORDER BY c DESC, abs(dv) + abs(du), dv, du) = 1""",
)
def frame_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The move that lines each frame up with the background."""
    out = images.shift(grey(spark, sf_dir).select("frame", "v", "u", "value"), background(spark, sf_dir), 1)
    return out.withColumn("correlation", F.round("correlation", 6))


@query(
    "best_match",
    f"""
WITH g AS ({GREY_SQL}), b AS ({BACK_SQL}), c AS (SELECT g.label, g.frame, corr(g.value, b.value) AS c FROM g JOIN b ON b.v = g.v AND b.u = g.u GROUP BY ALL)
SELECT label, arg_max(frame, {{'c': round(c, 9), 'f': -frame}}) AS frame, round(max(c), 6) AS correlation FROM c GROUP BY 1""",
)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label's candidates, the one that matches a template best."""
    fit = images.matched(background(spark, sf_dir), grey(spark, sf_dir), ["label", "frame"])
    best = F.max(F.struct(F.round("correlation", 9).alias("c"), (-F.col("frame")).alias("f"))).alias("_b")
    return fit.groupBy("label").agg(best, F.round(F.max("correlation"), 6).alias("correlation")).select("label", (-F.col("_b.f")).alias("frame"), "correlation")


def filter_sql(name: str, source: str, cutoff: float) -> str:
    """A pass of the filter over ``source`` (series, i, x), i from 0, as a table (series, i, x): one step of all series at a time."""
    k = math.tan(math.pi * cutoff / 2)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    b, a1, a2 = (f"({x!r})::DOUBLE" for x in (n, 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n))
    return f"""
{name}_r AS (
  SELECT series, -1 AS i, 0.0::DOUBLE AS y, -{b} * x AS z1, {b} * x AS z2 FROM {source} WHERE i = 0
  UNION ALL
  SELECT r.series, s.i, {b} * s.x + z1, -2 * {b} * s.x - {a1} * ({b} * s.x + z1) + z2, {b} * s.x - {a2} * ({b} * s.x + z1) FROM {name}_r r JOIN {source} s ON s.series = r.series AND s.i = r.i + 1),
{name} AS (SELECT series, i, y AS x FROM {name}_r WHERE i >= 0)"""


def passed_sql(series: str, cutoff: float) -> str:
    """Tables to go on with: ``series`` (q: series, frame, value, i), its ends (m) and the filtered series h (series, frame, value, passed), with nine reflected moments at either end."""
    return f"""
WITH RECURSIVE q AS ({series}),
m AS (SELECT series, count(*) AS n, least(9, count(*) - 1) AS pad, max(value) FILTER (i = 0) AS a, arg_max(value, i) AS b FROM q GROUP BY 1),
e AS (
  SELECT series, i + pad AS i, value AS x FROM q JOIN m USING (series)
  UNION ALL SELECT series, pad - i, 2 * a - value FROM q JOIN m USING (series) WHERE i BETWEEN 1 AND pad
  UNION ALL SELECT series, pad + 2 * n - 2 - i, 2 * b - value FROM q JOIN m USING (series) WHERE i BETWEEN n - 1 - pad AND n - 2),
{filter_sql("f", "e", cutoff)},
t AS (SELECT series, n + 2 * pad - 1 - i AS i, x FROM f JOIN m USING (series)),
{filter_sql("g", "t", cutoff)},
h AS (SELECT q.series, q.frame, q.value, g.x AS passed FROM q JOIN m USING (series) JOIN g ON g.series = q.series AND g.i = n + 2 * pad - 1 - (q.i + pad))
"""


HIGH_SQL = passed_sql(f"SELECT label * 64 + v * 8 + u AS series, frame, value, row_number() OVER (PARTITION BY label, v, u ORDER BY frame) - 1 AS i FROM ({PX_SQL})", 0.2)


@query("high_passed", HIGH_SQL + "SELECT CAST(series // 64 AS INTEGER) AS label, frame, CAST(series % 64 // 8 AS INTEGER) AS v, CAST(series % 8 AS INTEGER) AS u, round(passed, 6) + 0.0 AS passed FROM h")
def high_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel's fast changes over a label's frames."""
    px = all_pixels(spark, sf_dir).select("label", "frame", "v", "u", "value")
    out = series.high_pass(px, ["label", "v", "u"], ["frame"], "value", 0.2)
    return out.select("label", "frame", "v", "u", (F.round("passed", 6) + 0.0).alias("passed"))


@query(
    "quality_gate",
    """
WITH c AS (SELECT user_id, count(*) FILTER (value > 40) AS strong, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, CASE WHEN strong / n > 0.5 THEN 'doubtful' ELSE 'ok' END AS grade, strong / n > 0.5 AS warned FROM c""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades checked before use; here a doubtful one only warns."""
    from skyplume.operators.gates import gated

    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 40).alias("strong"), F.count("*").alias("n"))
    grade = F.when(F.col("strong") / F.col("n") > 0.5, "doubtful").otherwise("ok")
    return gated(c.select("user_id", grade.alias("grade")), F.col("grade") != "doubtful", "doubtful wind", required=False)


@query("rounded_numbers", "SELECT event_id, round_even(value * 10, 0) / 10 AS one_place, CAST(trunc(value) AS INTEGER) AS whole, CAST(round_even(value, 0) AS INTEGER) AS nearest FROM events")
def rounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding half to even, and cutting."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", (F.rint(v * 10) / 10).alias("one_place"), v.cast("int").alias("whole"), F.rint(v).cast("int").alias("nearest"))


@query("finite_mean_by_label", f"WITH p AS (SELECT label, CASE WHEN abs(value) < 0.05 THEN 'nan'::DOUBLE ELSE value END AS x FROM ({PX_SQL})) SELECT label, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS middle FROM p WHERE NOT isnan(x) GROUP BY 1")
def finite_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small components are lost as NaN; the rest is summed up."""
    from skyplume.operators.quantiles import quantiles

    px = all_pixels(spark, sf_dir).select("label", F.when(F.abs("value") < 0.05, F.lit(float("nan"))).otherwise(F.col("value")).alias("x"))
    mean = px.groupBy("label").agg(F.count(finite(F.col("x"))).alias("n"), F.round(F.avg(finite(F.col("x"))), 6).alias("mean"))
    return mean.join(quantiles(px, ["label"], F.col("x"), [0.5], ["middle"]).withColumn("middle", F.round("middle", 6)), "label")
