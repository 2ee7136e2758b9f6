"""Masks, evidence and voxels beyond single frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.jobs.geometry_jobs import ON_SQL, PX_SQL, on_pixels
from skyplume.jobs.registry import query, table
from skyplume.operators import fits, masks, sampling
from skyplume.sources import records


def all_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, label, v, u, value) of every pixel."""
    px = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.posexplode("embedding").alias("i", "value"))
    return px.select("frame", "label", F.floor(F.col("i") / 8).cast("int").alias("v"), (F.col("i") % 8).cast("int").alias("u"), F.col("value").cast("double").alias("value"))


@query(
    "mask_bits",
    f"""
WITH b AS (SELECT frame, v, CAST(sum(128 >> u) AS INTEGER) AS x FROM ({ON_SQL}) GROUP BY ALL), f AS (SELECT DISTINCT frame FROM b)
SELECT f.frame, string_agg(format('{{:02X}}', coalesce(x, 0)), '' ORDER BY r.v) AS bits FROM f CROSS JOIN range(8) r(v) LEFT JOIN b ON b.frame = f.frame AND b.v = r.v GROUP BY 1""",
)
def mask_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.packed(on_pixels(spark, sf_dir), 8, 8).select("frame", F.hex("bits").alias("bits"))


@query("mask_from_bits", f"SELECT frame, v, u FROM ({ON_SQL})")
def mask_from_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed masks written, read and unpacked again."""
    from skyplume.sources.folder import shared

    path = shared(spark, "masks")
    masks.packed(on_pixels(spark, sf_dir), 8, 8).write.parquet(path)
    return masks.unpacked(spark.read.parquet(path))


@query("mask_union", f"SELECT DISTINCT frame, v, u FROM ({PX_SQL}) WHERE value > 0.15 OR value < -0.15")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = all_pixels(spark, sf_dir)
    return masks.merged(px.filter("value > 0.15"), px.filter("value < -0.15"))


@query(
    "mask_agreement",
    f"""
WITH f AS (SELECT DISTINCT vec_id AS frame FROM embeddings), a AS (SELECT frame, v, u FROM ({PX_SQL}) WHERE value > 0.25), b AS (SELECT frame, v, u FROM ({PX_SQL}) WHERE value > 0.22 AND u < 6),
j AS (SELECT coalesce(a.frame, b.frame) AS frame, count(*) FILTER (a.frame IS NOT NULL AND b.frame IS NOT NULL) AS i, count(*) AS n, count(a.frame) AS x, count(b.frame) AS y FROM a FULL JOIN b ON a.frame = b.frame AND a.v = b.v AND a.u = b.u GROUP BY 1)
SELECT f.frame, round(coalesce(i / n, 1), 6) AS iou, round(coalesce(2 * i / (x + y), 1), 6) AS dice FROM f LEFT JOIN j USING (frame)""",
)
def mask_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two masks over all frames; frames that are empty in both agree."""
    px = all_pixels(spark, sf_dir)
    out = masks.overlap(px.filter("value > 0.25"), px.filter("value > 0.22 and u < 6"), px.select("frame"))
    return out.select("frame", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


@query("static_shadow", f"SELECT v, u, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS share FROM ({ON_SQL}) GROUP BY ALL HAVING count(*) / (SELECT count(*) FROM embeddings) >= 0.5")
def static_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that are dark in half of the frames."""
    frames = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"))
    return masks.often_on(on_pixels(spark, sf_dir), frames, 0.5).withColumn("share", F.round("share", 6))


@query("shadow_evidence", f"SELECT frame, v, u, CAST(CASE WHEN abs(value) < 0.02 OR u = 7 THEN -1 WHEN value > 0 THEN 1 ELSE 0 END AS TINYINT) AS evidence FROM ({PX_SQL})")
def shadow_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = masks.evidence(all_pixels(spark, sf_dir), F.col("value") > 0, (F.abs("value") < 0.02) | (F.col("u") == 7))
    return px.select("frame", "v", "u", "evidence")


VOXEL_SQL = f"SELECT frame, v, u, CAST(unnest(range(CAST(floor(abs(value) * 32) AS BIGINT) + 1)) AS BIGINT) AS k FROM ({PX_SQL})"
EVIDENCE_SQL = f"SELECT frame, v, u, CASE WHEN abs(value) < 0.02 OR u = 7 THEN -1 WHEN value > 0 THEN 1 ELSE 0 END AS evidence FROM ({PX_SQL})"


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pixels(spark, sf_dir).select("frame", "v", "u", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.abs("value") * 32))).alias("k"))


@query("solar_carving", f"WITH x AS ({VOXEL_SQL}), e AS ({EVIDENCE_SQL}) SELECT x.frame, x.v, x.u, x.k, evidence <> 1 AS strict, evidence = 0 AS loose FROM x JOIN e USING (frame, v, u)")
def solar_carving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sun's evidence declares empty, in both forms."""
    x, e = voxels(spark, sf_dir), shadow_evidence(spark, sf_dir)
    strict = masks.sunlit(x, e, True).withColumnRenamed("free", "strict")
    return strict.join(masks.sunlit(x, e, False).withColumnRenamed("free", "loose"), ["frame", "v", "u", "k"])


@query(
    "carving_modes",
    f"""
WITH x AS ({VOXEL_SQL}), e AS ({EVIDENCE_SQL}), j AS (SELECT frame, k, evidence = 1 AS s, evidence <> 0 AS l FROM x JOIN e USING (frame, v, u)),
g AS (SELECT frame, count(*) AS n, count(*) FILTER (s) AS ns, count(*) FILTER (l) AS nl, quantile_cont(k, 0.99) AS h, quantile_cont(k, 0.99) FILTER (s) AS hs, quantile_cont(k, 0.99) FILTER (l) AS hl FROM j GROUP BY 1),
m AS (SELECT *, CASE WHEN ns >= 0.25 * n AND coalesce(hs >= 0.6 * h, false) THEN 'strict' WHEN nl >= 0.25 * n AND coalesce(hl >= 0.6 * h, false) THEN 'permissive' ELSE 'no shadow' END AS mode FROM g)
SELECT frame, mode, CASE mode WHEN 'strict' THEN ns WHEN 'permissive' THEN nl ELSE n END AS kept, n AS n_voxels FROM m""",
)
def carving_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.carve_with_fallback(voxels(spark, sf_dir), shadow_evidence(spark, sf_dir))


VARIANT_SQL = f"SELECT frame, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS variant, v, u FROM ({PX_SQL}), range(3) t(k) WHERE value > k * 0.03"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(i * 0.03).alias("least")) for i, n in enumerate("abc")]))
    return all_pixels(spark, sf_dir).withColumn("k", k).filter(F.col("value") > F.col("k.least")).select("frame", F.col("k.variant").alias("variant"), "v", "u")


@query(
    "mask_consensus",
    f"""
WITH p AS ({VARIANT_SQL}), f AS (SELECT frame FROM p GROUP BY 1 HAVING count(DISTINCT variant) = 3), q AS (SELECT * FROM p SEMI JOIN f USING (frame)),
c AS (SELECT frame, v, u FROM q GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT frame, count(*) AS area FROM c GROUP BY 1),
x AS (SELECT q.frame, q.variant, count(*) AS a, count(c.frame) AS i FROM q LEFT JOIN c ON c.frame = q.frame AND c.v = q.v AND c.u = q.u GROUP BY ALL),
y AS (SELECT x.frame, variant, a, coalesce(area, 0) AS area, i / (a + coalesce(area, 0) - i) AS iou FROM x LEFT JOIN s USING (frame))
SELECT frame, area, round(stddev_pop(a) / avg(a), 6) AS cv_area, round(avg(iou), 6) AS mean_iou, round(min(iou), 6) AS least_iou, arg_min(variant, {{'i': iou, 'n': variant}}) AS least_variant FROM y GROUP BY ALL""",
)
def mask_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three thresholds of a frame against their majority."""
    out = masks.consensus(variants(spark, sf_dir), "variant", 3)
    return out.select("frame", "area", *[F.round(c, 6).alias(c) for c in ("cv_area", "mean_iou", "least_iou")], "least_variant")


@query(
    "truth_comparison",
    f"""
WITH a AS (SELECT frame, v, u FROM ({PX_SQL}) WHERE value > 0.1 AND label IN (0, 1)), b AS (SELECT frame, v, u FROM ({PX_SQL}) WHERE value > 0.12 AND label IN (1, 2)),
p AS (SELECT x.frame, y.frame AS model_frame FROM (SELECT DISTINCT frame FROM a) x JOIN (SELECT DISTINCT frame FROM b) y ON abs(x.frame - y.frame) <= 2 QUALIFY row_number() OVER (PARTITION BY x.frame ORDER BY abs(x.frame - y.frame), y.frame) = 1),
m AS (SELECT p.frame, p.model_frame, a.v, a.u FROM a JOIN p USING (frame)), o AS (SELECT p.frame, p.model_frame, b.v, b.u FROM b JOIN p ON b.frame = p.model_frame),
j AS (SELECT coalesce(m.frame, o.frame) AS frame, coalesce(m.model_frame, o.model_frame) AS model_frame, m.frame IS NOT NULL AS x, o.frame IS NOT NULL AS y FROM m FULL JOIN o ON m.frame = o.frame AND m.v = o.v AND m.u = o.u)
SELECT frame, model_frame, count(*) FILTER (x) AS true_area, count(*) FILTER (y) AS area, round(count(*) FILTER (y) / count(*) FILTER (x), 6) AS ratio, count(*) FILTER (y AND NOT x) AS false_pixels, count(*) FILTER (x AND NOT y) AS missed, round(count(*) FILTER (x AND y) / count(*), 6) AS iou FROM j GROUP BY ALL""",
)
def truth_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced frames against the nearest predicted ones."""
    px = all_pixels(spark, sf_dir)
    out = masks.compared(px.filter("value > 0.1 and label in (0, 1)"), px.filter("value > 0.12 and label in (1, 2)"), 2)
    return out.withColumns({"ratio": F.round("ratio", 6), "iou": F.round("iou", 6)})


@query(
    "box_cover",
    "SELECT DISTINCT l_suppkey, v, u FROM (SELECT l_suppkey, unnest(range(v0, v1 + 1)) AS v, u0, u1 FROM (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS v0, CAST(l_quantity AS INTEGER) + 2 AS v1, l_linenumber * 3 AS u0, l_linenumber * 3 + 4 AS u1 FROM lineitem)), range(50) r(u) WHERE u BETWEEN u0 AND u1",
)
def box_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that boxes cover."""
    v0, u0 = F.col("l_quantity").cast("int"), F.col("l_linenumber") * 3
    out = masks.rectangles(table(spark, sf_dir, "lineitem").select("l_suppkey", v0.alias("v0"), (v0 + 2).alias("v1"), u0.alias("u0"), (u0 + 4).alias("u1")), ["l_suppkey"])
    return out.select("l_suppkey", F.col("v").cast("long").alias("v"), F.col("u").cast("long").alias("u"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation files as text: each part a triangle and a rectangle in two frames."""
    # Few bytes become many texts and pixels: dealt out before they do.
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), (F.col("p_partkey") % 17).cast("double").alias("r")).repartition("p_partkey")
    point = lambda x, y: F.array(x, y)
    zero = F.lit(0.0)
    triangle, box = F.array(point(zero, zero), point(F.col("s"), zero), point(zero, F.col("r"))), F.array(point(F.col("r"), zero), point(F.col("r") + 3, zero), point(F.col("r") + 3, F.col("s")), point(F.col("r"), F.col("s")))
    frames = F.create_map(F.col("p_partkey").cast("string"), F.array(triangle, box), (F.col("p_partkey") + 1).cast("string"), F.array(triangle))
    return p.select("p_partkey", F.to_json(F.struct(F.lit("clip").alias("video"), F.lit(0.5).alias("escala"), frames.alias("frames"))).alias("text"))


@query(
    "annotation_areas",
    """
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 17)::DOUBLE AS r FROM part)
SELECT p_partkey, p_partkey AS frame, 0 AS polygon, round(s * r / 2, 6) AS area FROM p UNION ALL SELECT p_partkey, p_partkey, 1, round(3 * s, 6) FROM p UNION ALL SELECT p_partkey, p_partkey + 1, 0, round(s * r / 2, 6) FROM p""",
)
def annotation_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation files read back: polygons of each frame and their areas."""
    rows = records.annotations(annotated(spark, sf_dir), ["p_partkey"], "text")
    return rows.select("p_partkey", "frame", "polygon", F.round(records.polygon_area(F.col("points")), 6).alias("area"))


@query(
    "polygon_pixels",
    """
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 17)::DOUBLE AS r FROM part)
SELECT p_partkey, CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u FROM p, range(24) a(v), range(24) b(u) WHERE r > 0 AND v < r AND u >= 0 AND u < round(s * (1 - v / r), 9)""",
)
def polygon_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles as masks."""
    rows = records.annotations(annotated(spark, sf_dir), ["p_partkey"], "text").filter((F.col("frame") == F.col("p_partkey")) & (F.col("polygon") == 0))
    return masks.polygon_pixels(rows, ["p_partkey"], "points", 24, 24)


REACH_SQL = """
WITH RECURSIVE p AS ({on}), r AS (SELECT frame, v * 8 + u AS seed, v, u FROM p UNION SELECT r.frame, r.seed, p.v, p.u FROM r JOIN p ON p.frame = r.frame AND abs(p.v - r.v) <= 1 AND abs(p.u - r.u) <= 1),
l AS (SELECT frame, v, u, min(seed) AS c FROM r GROUP BY ALL), s AS (SELECT frame, c, count(*) AS n, avg(v) AS v, avg(u) AS u FROM l GROUP BY ALL)
"""


@query("seed_component", REACH_SQL.format(on=f"SELECT frame, v, u FROM ({PX_SQL}) WHERE value > 0.12") + "SELECT frame, max(n) AS area FROM s WHERE sqrt(pow(v - 3, 2) + pow(u - 3, 2)) <= 2.5 GROUP BY 1")
def seed_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component near the pivot."""
    return masks.seed_component(all_pixels(spark, sf_dir).filter("value > 0.12"), (3.0, 3.0), 2.5).select("frame", "area")


@query(
    "solid_components",
    f"""
WITH RECURSIVE p AS (SELECT DISTINCT frame, v, u, CAST(floor(abs(value) * 16) AS BIGINT) AS k FROM ({PX_SQL}) WHERE value > 0.08),
r AS (SELECT frame, (v * 8 + u) * 100 + k AS seed, v, u, k FROM p UNION SELECT r.frame, r.seed, p.v, p.u, p.k FROM r JOIN p ON p.frame = r.frame AND abs(p.v - r.v) + abs(p.u - r.u) + abs(p.k - r.k) = 1),
l AS (SELECT frame, v, u, k, min(seed) AS c FROM r GROUP BY ALL), s AS (SELECT frame, c, count(*) AS n FROM l GROUP BY ALL)
SELECT frame, count(*) AS n_components, max(n) AS largest FROM s GROUP BY 1""",
)
def solid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = all_pixels(spark, sf_dir).filter("value > 0.08").select("frame", "v", "u", F.floor(F.abs("value") * 16).alias("k"))
    return masks.largest_solid(px)


@query("strided_pixels", f"SELECT frame, v, u FROM ({ON_SQL}) WHERE v % 3 = 0 AND u % 3 = 0")
def strided_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third pixel of every third row: the stride is the operator."""
    return sampling.strided(on_pixels(spark, sf_dir), 3).select("frame", "v", "u")


@query(
    "hull_moments",
    f"""
WITH x AS ({VOXEL_SQL}), m AS (SELECT frame, count(*) * 8.0 AS volume, avg(u * 2.0) AS e, avg(v * 2.0) AS n, avg(k * 2.0) AS h, max(k * 2.0) AS top, var_pop(u * 2.0) AS sxx, var_pop(v * 2.0) AS syy, covar_pop(u * 2.0, v * 2.0) AS sxy, stddev_pop(k * 2.0) AS sz FROM x GROUP BY 1),
a AS (SELECT *, sin(radians(40.0::DOUBLE)) AS s, cos(radians(40.0::DOUBLE)) AS c FROM m)
SELECT frame, volume, round(e, 6) AS east, round(n, 6) AS north, round(h, 6) AS up, top, round(sqrt(s * s * sxx + 2 * s * c * sxy + c * c * syy), 6) AS along, round(sqrt(c * c * sxx - 2 * s * c * sxy + s * s * syy), 6) AS across, round(sz, 6) AS vertical FROM a""",
)
def hull_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, centre and spread of voxel clouds along and across the wind."""
    at = {"e": F.col("u") * 2.0, "n": F.col("v") * 2.0, "h": F.col("k") * 2.0}
    m = voxels(spark, sf_dir).groupBy("frame").agg((F.count("*") * 8.0).alias("volume"), *[F.avg(c).alias(n) for n, c in at.items()], F.max(at["h"]).alias("top"), F.var_pop(at["e"]).alias("sxx"), F.var_pop(at["n"]).alias("syy"), F.covar_pop(at["e"], at["n"]).alias("sxy"), F.stddev_pop(at["h"]).alias("sz"))
    along, across = fits.directional_sigma(F.col("sxx"), F.col("syy"), F.col("sxy"), 40.0)
    return m.select("frame", "volume", F.round("e", 6).alias("east"), F.round("n", 6).alias("north"), F.round("h", 6).alias("up"), "top", F.round(along, 6).alias("along"), F.round(across, 6).alias("across"), F.round("sz", 6).alias("vertical"))
