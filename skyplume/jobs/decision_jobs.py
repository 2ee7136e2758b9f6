"""Windows of established wind, the growth of a shock front, refined spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.jobs.geometry_jobs import PX_SQL
from skyplume.jobs.image_jobs import passed_sql
from skyplume.jobs.mask_jobs import all_pixels
from skyplume.jobs.registry import query, table
from skyplume.jobs.series_jobs import AZ_SQL, azimuth
from skyplume.operators import refine, shock, windows

FLOW_SQL = f"""
SELECT user_id, row_number() OVER w * 400 AS ms, {AZ_SQL} / 9 AS angle, (value % 10) / 10 AS texture, value % 50 AS edge_distance, (value % 7) / 200 AS cut, value % 3 AS up, value % 11 AS speed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a clip a user, a frame each 400 ms."""
    from pyspark.sql import Window as W

    v, ms = F.col("value"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) * 400
    return table(spark, sf_dir, "events").select("user_id", ms.alias("ms"), (azimuth() / 9).alias("angle"), ((v % 10) / 10).alias("texture"), (v % 50).alias("edge_distance"), ((v % 7) / 200).alias("cut"), (v % 3).alias("up"), (v % 11).alias("speed"))


def held_sql(value: str, test: str, span: int, source: str, since: str = "") -> str:
    """First moment from which ``test`` holds for ``span`` and two rows or more."""
    return f"""
  SELECT user_id, min(ms) FILTER (ok AND n > 1{since}) AS first_at FROM (
    SELECT user_id, ms, start, bool_and(coalesce({value} {test}, false)) OVER w AS ok, count(*) OVER w AS n FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN CURRENT ROW AND {span} FOLLOWING)) GROUP BY 1"""


def smooth_sql(c: str) -> str:
    """Moving mean of five rows, the ends repeated."""
    return f"CASE WHEN n >= 5 THEN (sum({c}) OVER w + first_value({c}) OVER a * greatest(3 - i, 0) + last_value({c}) OVER a * greatest(2 + i - n, 0)) / 5 ELSE {c} END"


WINDOW_SQL = f"""
WITH f AS ({FLOW_SQL}),
d AS (SELECT *, CASE WHEN lag(angle) OVER o IS NULL THEN 0 ELSE ((angle - lag(angle) OVER o + 180) % 360 + 360) % 360 - 180 END AS step, row_number() OVER o AS i, count(*) OVER (PARTITION BY user_id) AS n FROM f WINDOW o AS (PARTITION BY user_id ORDER BY ms)),
u AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ms) AS way FROM d),
g AS (SELECT *, abs(coalesce((lead(way) OVER o - lag(way) OVER o) / (lead(ms) OVER o - lag(ms) OVER o), (lead(way) OVER o - way) / (lead(ms) OVER o - ms), (way - lag(way) OVER o) / (ms - lag(ms) OVER o))) * 1000 AS turn, up / greatest(speed, 1e-6) AS rise, 0 AS start FROM u WINDOW o AS (PARTITION BY user_id ORDER BY ms)),
s AS (SELECT user_id, ms, cut, turn, rise, {smooth_sql("texture")} AS tex, {smooth_sql("edge_distance")} AS edge FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ms ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), a AS (PARTITION BY user_id ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
tb AS ({held_sql("turn", "< 40", 800, "g")}), ta AS ({held_sql("rise", "< 0.6", 800, "g")}),
b AS (SELECT user_id, min(ms) AS lo, max(ms) AS hi FROM f GROUP BY 1),
st AS (SELECT b.*, ta.first_at AS rise_at, tb.first_at AS turn_at, coalesce(greatest(ta.first_at, tb.first_at), lo) AS start FROM b JOIN ta USING (user_id) JOIN tb USING (user_id)),
l AS (SELECT s.*, start FROM s JOIN st USING (user_id)),
tc AS ({held_sql("tex", "< 0.4", 800, "l", " AND ms >= start")}), t1 AS ({held_sql("edge", "< 20", 400, "l", " AND ms >= start")}), t2 AS ({held_sql("cut", "> 0.02", 400, "l", " AND ms >= start")}),
e AS (SELECT st.*, tc.first_at AS texture_at, least(t1.first_at, t2.first_at) AS edge_at FROM st JOIN tc USING (user_id) JOIN t1 USING (user_id) JOIN t2 USING (user_id)),
z AS (SELECT *, coalesce(least(texture_at, edge_at), hi) AS stop0 FROM e),
win AS (SELECT user_id, start, CASE WHEN stop0 <= start THEN hi ELSE stop0 END AS stop, rise_at, turn_at, texture_at, edge_at, stop0 <= start AS degenerate FROM z)
"""


def wind_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flow(spark, sf_dir)
    return windows.established(rows, ["user_id"], "ms", 100.0, rows.select("user_id", "ms", "up", "speed"), rise=0.6, turn=40.0, hold=0.8, texture=0.4, margin=0.2, hold_edge=0.4, smooth=5)


@query("established_windows", WINDOW_SQL + "SELECT user_id, start, stop, rise_at, turn_at, texture_at, edge_at, degenerate FROM win")
def established_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of each user's window by all criteria."""
    out = wind_windows(spark, sf_dir)
    return out.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("start", "stop", "rise_at", "turn_at", "texture_at", "edge_at")], "degenerate")


@query(
    "window_summaries",
    WINDOW_SQL + """, j AS (SELECT f.user_id, angle * 9 AS a, speed AS v FROM f JOIN win USING (user_id) WHERE ms BETWEEN start AND stop),
m AS (SELECT user_id, count(*) AS n, sum(v * sin(radians(a))) / sum(v) AS s, sum(v * cos(radians(a))) / sum(v) AS c, avg(v) AS mean, median(v) AS middle, min(v) AS slowest, max(v) AS fastest FROM j GROUP BY 1)
SELECT user_id, n, round((degrees(atan2(s, c)) + 360) % 360, 4) AS toward, round((degrees(atan2(s, c)) + 540) % 360, 4) AS comes_from, round(degrees(sqrt(-2 * ln(least(sqrt(s * s + c * c), 1)))), 4) AS spread, round(mean, 6) AS mean, round(middle, 6) AS middle, round(slowest, 6) AS slowest, round(fastest, 6) AS fastest FROM m""",
)
def window_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wind within each user's window, weighted by speed."""
    rows = flow(spark, sf_dir).withColumn("azimuth", F.col("angle") * 9)
    out = windows.summarised(rows, ["user_id"], "ms", wind_windows(spark, sf_dir))
    return out.select("user_id", "n", *[F.round(c, 4).alias(c) for c in ("toward", "comes_from", "spread")], *[F.round(c, 6).alias(c) for c in ("mean", "middle", "slowest", "fastest")])


@query(
    "front_growth",
    """
WITH p AS (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS frame, l_linenumber AS place, l_quantity * 21.5 + l_discount * 100 + CASE WHEN l_suppkey % 5 = 0 THEN -l_quantity * 40 ELSE 0 END AS x, l_tax * 50 AS y, l_orderkey FROM lineitem),
c AS (SELECT l_suppkey, arg_min({'f': frame, 'x': x, 'y': y}, {'f': frame, 'p': l_orderkey * 10 + place}) AS c FROM p GROUP BY 1),
r AS (SELECT p.l_suppkey, frame - c.f AS dt, sqrt(pow(x - c.x, 2) + pow(y - c.y, 2)) AS r, c.f AS f FROM p JOIN c USING (l_suppkey) WHERE frame <> c.f),
m AS (SELECT l_suppkey, count(*) AS n, regr_slope(r, dt) AS slope, regr_intercept(r, dt) AS intercept, regr_r2(r, dt) AS r2, max(f) AS f FROM r GROUP BY 1)
SELECT l_suppkey, n, round(slope, 5) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(f - intercept / slope, 4) AS zero_frame, round(slope * 30 / 340.3, 6) AS pixels_per_metre FROM m WHERE n >= 3 AND slope > 0""",
)
def front_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked points of a front: scale and the moment between frames at which it began."""
    q = F.col("l_quantity")
    x = q * 21.5 + F.col("l_discount") * 100 + F.when(F.col("l_suppkey") % 5 == 0, -q * 40).otherwise(0)
    points = table(spark, sf_dir, "lineitem").select("l_suppkey", q.cast("long").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), x.alias("x"), (F.col("l_tax") * 50).alias("y"))
    out = shock.front_line(shock.clicked(points, ["l_suppkey"]), ["l_suppkey"], "reference", 30.0, 340.3)
    return out.select("l_suppkey", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("zero_frame", 4).alias("zero_frame"), F.round("pixels_per_metre", 6).alias("pixels_per_metre"))


PULSE_SQL = passed_sql(f"SELECT v * 8 + u AS series, frame, value * 200 AS value, row_number() OVER (PARTITION BY v, u ORDER BY frame) - 1 AS i FROM ({PX_SQL})", 0.3)


@query(
    "brightness_pulses",
    PULSE_SQL + """, p AS (SELECT series, series % 8 * 2 // 8 AS strip, stddev_pop(value) * 1.5 AS own FROM q WHERE frame < 30 GROUP BY ALL), c AS (SELECT strip, median(own) AS cap FROM p GROUP BY 1),
o AS (SELECT series, least(own, cap) AS floor FROM p JOIN c USING (strip)), a AS (SELECT series, frame, abs(passed) AS x FROM h),
w AS (SELECT *, lag(x, 1) OVER s AS b1, lag(x, 2) OVER s AS b2, lead(x, 1) OVER s AS a1, lead(x, 2) OVER s AS a2 FROM a WINDOW s AS (PARTITION BY series ORDER BY frame))
SELECT frame, CAST(series // 8 AS INTEGER) AS v, CAST(series % 8 AS INTEGER) AS u, round(x, 6) AS strength FROM w JOIN o USING (series) WHERE x > b1 AND x > b2 AND x > a1 AND x > a2 AND x > floor""",
)
def brightness_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulses of all pixels over all frames, against floors from the first thirty."""
    px = all_pixels(spark, sf_dir).select("frame", "v", "u", (F.col("value") * 200).alias("value"))
    return shock.pulses(px, shock.noise_floors(px.filter("frame < 30"), 8, 1.5, 2), 0.3).withColumn("strength", F.round("strength", 6))


#: A camera 1,000 m up that looks down at 40 degrees to the north-east.
CAMERA = Camera.at(1400.0, (500.0, 400.0, 1000.0), 45.0, -50.0, 1920, 1080)
REFINE_SQL = """
WITH p AS (SELECT p_partkey, p_partkey % 50 AS clip, 100 + p_size * 9.0::DOUBLE AS see, 80 + (p_partkey % 23) * 7.0::DOUBLE AS snn, (p_size - 25) * 0.8::DOUBLE AS sen, 300 + p_size * 2.0::DOUBLE AS east, 700 - p_size * 3.0::DOUBLE AS north, 60.0::DOUBLE AS z, 10 + (p_partkey % 31)::DOUBLE AS up, 0.2 + (p_partkey % 7) / 20.0::DOUBLE AS ratio FROM part),
f AS (SELECT *, (980 - up) / (980 - (z - 20)) AS f FROM p),
c AS (SELECT p_partkey, clip, ratio, up, f, see * f * f AS see, snn * f * f AS snn, sen * f * f AS sen, 500 + f * (east - 500) AS east, 400 + f * (north - 400) AS north FROM f),
w AS (SELECT *, sin(radians(70.0::DOUBLE)) AS s, cos(radians(70.0::DOUBLE)) AS k, tan(radians(40.0::DOUBLE)) AS t, cos(radians(25.0::DOUBLE)) AS ia, sin(radians(25.0::DOUBLE)) AS ic FROM c),
g AS (SELECT *, sqrt(greatest(s * s * see + 2 * s * k * sen + k * k * snn, 0)) AS al, sqrt(greatest(k * k * see - 2 * s * k * sen + s * s * snn, 0)) AS cr FROM w),
z0 AS (SELECT *, ratio * cr AS z0 FROM g)""" + "".join(f""",
z{n} AS (SELECT *, ratio * sqrt(greatest(cr * cr - pow(z{n - 1} * t * ic, 2), 1e-6)) AS z{n} FROM z{n - 1}), m{n} AS (SELECT clip, max(abs(z{n} - z{n - 1})) AS m{n} FROM z{n} GROUP BY 1)""" for n in range(1, 5))  # fmt: skip


@query(
    "refined_spreads",
    REFINE_SQL + """, r AS (SELECT *, CASE WHEN m1 < 1e-4 THEN 1 WHEN m2 < 1e-4 THEN 2 WHEN m3 < 1e-4 THEN 3 ELSE 4 END AS rounds FROM z4 JOIN m1 USING (clip) JOIN m2 USING (clip) JOIN m3 USING (clip) JOIN m4 USING (clip)),
e AS (SELECT *, [z0, z1, z2, z3, z4] AS z, [m1, m2, m3, m4] AS m FROM r)
SELECT p_partkey, round(f, 6) AS factor, round(east, 4) AS east, round(north, 4) AS north, round(sqrt(greatest(al * al - pow(z[rounds] * t * ia, 2), 1e-6)), 5) AS along, round(sqrt(greatest(cr * cr - pow(z[rounds] * t * ic, 2), 1e-6)), 5) AS across, round(z[rounds + 1], 5) AS vertical, CAST(rounds AS INTEGER) AS rounds, round(m[rounds], 6) AS change FROM e""",
)
def refined_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments brought to the right plane, and widths with the cloud's height taken out."""
    p, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", (p % 50).alias("clip"), (100 + size * 9.0).alias("see"), (80 + (p % 23) * 7.0).alias("snn"), ((size - 25) * 0.8).alias("sen"), (300 + size * 2.0).alias("east"), (700 - size * 3.0).alias("north"),
        F.lit(60.0).alias("z"), (10.0 + p % 31).alias("up"), (0.2 + (p % 7) / 20.0).alias("ratio"),
    )
    out = refine.refined(refine.on_right_plane(rows, CAMERA, 20.0, "z", "up"), ["clip"], CAMERA, 70.0, "ratio")
    return out.select("p_partkey", F.round("factor", 6).alias("factor"), F.round("east", 4).alias("east"), F.round("north", 4).alias("north"), *[F.round(c, 5).alias(c) for c in ("along", "across", "vertical")], "rounds", F.round("change", 6).alias("change"))


SIGMA_SQL = "sqrt(greatest(CASE WHEN t <= e THEN {s0} + {k} * pow(t, {a}) ELSE {s0} + {k} * pow(e, {a}) + {k} * {a} * pow(e, {a} - 1) * (t - e) END, 1e-6))"
LAWS = {"along": ("10 + s_nationkey", "1.5::DOUBLE", "1.2::DOUBLE"), "across": ("8.0::DOUBLE", "1 + s_nationkey / 25", "1.0::DOUBLE"), "up": ("4.0::DOUBLE", "0.8::DOUBLE", "1.1::DOUBLE")}


@query(
    "concentrations",
    f"""
WITH c AS (SELECT s_suppkey, s_nationkey, abs(s_acctbal) + 10 AS m, 20 + s_suppkey % 30::DOUBLE AS h, 5 + s_nationkey::DOUBLE AS e FROM supplier),
g AS (SELECT *, greatest(e / 200, 0.05) AS f, greatest(10 * e, 150) AS l FROM c), t AS (SELECT g.*, i, f * pow(l / f, i / 39.0::DOUBLE) AS t FROM g, range(40) r(i)),
s AS (SELECT *, {", ".join(f"{SIGMA_SQL.format(s0=f'({a})', k=f'({b})', a=f'({c})')} AS {n}" for n, (a, b, c) in LAWS.items())} FROM t),
d AS (SELECT *, m / (pow(2 * pi(), 1.5) * along * across * up) AS q FROM s)
SELECT s_suppkey, CAST(i AS INTEGER) AS i, round(t, 6) AS t, round(q * (1 + exp(-2 * h * h / (up * up))), 8) AS cloud, round(q * (exp(-pow(1.5 - h, 2) / (2 * up * up)) + exp(-pow(1.5 + h, 2) / (2 * up * up))), 8) AS receptor FROM d""",
)
def concentrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puffs over time in their middle: at the cloud's height and where one breathes."""
    from skyplume.operators.fits import concentration_series

    n, x = F.col("s_nationkey"), lambda v: F.lit(float(v))
    laws = {"along": (10.0 + n, x(1.5), x(1.2)), "across": (x(8), 1 + n / 25.0, x(1)), "up": (x(4), x(0.8), x(1.1))}
    out = concentration_series(table(spark, sf_dir, "supplier"), ["s_suppkey"], F.abs("s_acctbal") + 10, 20.0 + F.col("s_suppkey") % 30, laws, 5.0 + n, n=40)
    return out.select("s_suppkey", "i", F.round("t", 6).alias("t"), F.round("cloud", 8).alias("cloud"), F.round("receptor", 8).alias("receptor"))


@query(
    "coverage_of_instants",
    """
WITH p AS (SELECT user_id, epoch_us(ts) // 1000000 AS t FROM events), q AS (SELECT DISTINCT o_custkey % 40 AS user_id, epoch_us(o_orderdate::TIMESTAMP) // 1000000 % 2764800 + 1703980800 AS instant FROM orders),
e AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM p GROUP BY 1),
n AS (SELECT q.user_id, q.instant, count(p.t) AS n, min(abs(p.t - q.instant)) AS d FROM q LEFT JOIN p ON p.user_id = q.user_id AND abs(p.t - q.instant) <= 43200 GROUP BY ALL),
v AS (SELECT n.*, CASE WHEN lo IS NULL THEN 'empty' WHEN instant < lo THEN 'before' WHEN instant > hi THEN 'after' WHEN n = 0 THEN 'hole' WHEN n < 3 THEN 'partial' ELSE 'full' END AS verdict FROM n LEFT JOIN e USING (user_id))
SELECT user_id, instant, verdict, n AS n_near, CASE WHEN verdict IN ('partial', 'full') THEN d END AS nearest FROM v""",
)
def coverage_of_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each user's events cover a table of moments, half a day either way."""
    from skyplume.functions.times import micros
    from skyplume.operators.joins import coverage_at

    seconds = lambda c: F.floor(micros(c) / 1_000_000)
    points = table(spark, sf_dir, "events").select("user_id", seconds("ts").alias("t"))
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("user_id"), (F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))) % 2_764_800 + 1_703_980_800).alias("instant"))
    return coverage_at(points, ["user_id"], "t", asked, 43_200, 3)
