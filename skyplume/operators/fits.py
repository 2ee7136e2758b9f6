"""Moments and fits as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyplume.functions.guards import finite
from skyplume.operators.quantiles import quantiles


def axis_of(sxx: Column, syy: Column, sxy: Column) -> Column:
    """Direction of the major axis of a 2 x 2 covariance, degrees in (-90, 90]."""
    return F.degrees(0.5 * F.atan2(2 * sxy, sxx - syy))


def eigenvalues(sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column]:
    mid, off = (sxx + syy) / 2, F.sqrt(F.pow((sxx - syy) / 2, 2) + F.pow(sxy, 2))
    return mid + off, mid - off


def weighted_moments(df: DataFrame, keys: list[str], u: Column, v: Column, w: Column) -> DataFrame:
    """mass, mean_u, mean_v, var_u, var_v, cov_uv per key, weighted; weights that add up to 0 give nulls.

    Two passes: the second is about the mean, so that large coordinates lose no digits.
    """
    # Rows that don't count weigh nothing: a filter would be pushed down and copy the expressions of u, v and w into it.
    rows = df.select(*keys, finite(u).alias("_u"), finite(v).alias("_v"), finite(w).alias("_w0"))
    rows = rows.select(*keys, "_u", "_v", F.when(F.col("_u").isNotNull() & F.col("_v").isNotNull(), F.col("_w0")).alias("_w"))
    total = F.nullif(F.sum("_w"), F.lit(0.0))
    means = rows.groupBy(*keys).agg(F.sum("_w").alias("mass"), (F.sum(F.col("_w") * F.col("_u")) / total).alias("mean_u"), (F.sum(F.col("_w") * F.col("_v")) / total).alias("mean_v")).filter("mass is not null")
    du, dv = F.col("_u") - F.col("mean_u"), F.col("_v") - F.col("mean_v")
    about = lambda x: (F.sum(F.col("_w") * x) / total)
    return rows.join(means, keys).groupBy(*keys, "mass", "mean_u", "mean_v").agg(about(du * du).alias("var_u"), about(dv * dv).alias("var_v"), about(du * dv).alias("cov_uv"))


def power_law(df: DataFrame, keys: list[str], t: str, s2: str, low: float = 0.2, step: float = 0.005, n: int = 561) -> DataFrame:
    """s2 = s0 + k * t^alpha per key by least squares over a grid of exponents.

    A negative s0 is refitted through the origin, k <= 0 is no fit; the least
    squared error wins, the smaller exponent of equals. Every row meets each of
    the ``n`` exponents; rows that are not finite and positive do not count.
    """
    x, y = F.col("_x"), F.col(s2)
    known = df.select(*keys, finite(F.col(t)).alias(t), finite(F.col(s2)).alias(s2)).filter((F.col(t) > 0) & (F.col(s2) > 0))
    rows = known.withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(low) + i * F.lit(step)))).withColumn("_x", F.pow(F.col(t), F.col("alpha")))
    lines = rows.groupBy(*keys, "alpha").agg(F.regr_slope(s2, "_x").alias("_k"), F.regr_intercept(s2, "_x").alias("_s"), (F.sum(x * y) / F.sum(x * x)).alias("_o"))
    down = F.col("_s") < 0
    lines = lines.select(*keys, "alpha", F.when(down, F.col("_o")).otherwise(F.col("_k")).alias("k"), F.when(down, 0.0).otherwise(F.col("_s")).alias("s0")).filter("k > 0")
    error = F.sum(F.pow(y - F.col("s0") - F.col("k") * x, 2)).alias("sse")
    fits = rows.join(lines, [*keys, "alpha"]).groupBy(*keys, "alpha", "k", "s0").agg(error)
    best = F.min_by(F.struct("alpha", "k", "s0", "sse"), F.struct("sse", "alpha"))
    return fits.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def trimmed_tip(df: DataFrame, keys: list[str], height: str, q: float = 0.98, margin: float = 3.0) -> DataFrame:
    """Median height of the rows within ``margin`` of the key's ``q`` quantile, and their number."""
    rows = df.select(*keys, finite(F.col(height)).alias("_h"))
    rows = rows.join(quantiles(rows, keys, F.col("_h"), [q], ["_p"]), keys).filter(F.col("_h") >= F.col("_p") - margin)
    return quantiles(rows, keys, F.col("_h"), [0.5], ["tip"]).join(rows.groupBy(*keys).agg(F.count("*").alias("n_tip")), keys)


def log_log(df: DataFrame, keys: list[str], t: str, s2: str) -> DataFrame:
    """s2 = k * t^alpha per key by least squares of the logarithms, and R2; rows that are not finite and positive do not count."""
    x, y = F.ln(F.when(finite(F.col(t)) > 0, F.col(t))), F.ln(F.when(finite(F.col(s2)) > 0, F.col(s2)))
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("alpha"), F.exp(F.regr_intercept(y, x)).alias("k"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def directional_sigma(var_u: Column, var_v: Column, cov_uv: Column, azimuth: float) -> tuple[Column, Column]:
    """Standard deviations along ``azimuth`` (degrees from the v axis towards u) and across it."""
    import math

    s, c = math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
    along = s * s * var_u + 2 * s * c * cov_uv + c * c * var_v
    across = c * c * var_u - 2 * s * c * cov_uv + s * s * var_v
    return F.sqrt(F.greatest(along, F.lit(0.0))), F.sqrt(F.greatest(across, F.lit(0.0)))


def world_sigmas(px: DataFrame, keys: list[str], camera, z: Column, weight: Column, least: int = 50) -> DataFrame:
    """Moments of weighted pixels (u, v) on the plane at height ``z``: sigma of the major and minor axis, azimuth of the major one (mod 180), centre.

    Weights are multiplied by the plane's area of each pixel; pixels that do not
    meet the plane or weigh nothing are left out, keys with fewer than ``least``
    are too. All pixels count, none are sampled.
    """
    # Directions of the pixel's ray, and of those half a pixel across and down, in steps that are each computed once.
    half = 0.5 / camera.focal
    rows = px.select(*keys, ((F.col("u") - camera.cx) / camera.focal).alias("_a"), ((F.col("v") - camera.cy) / camera.focal).alias("_b"), (z - camera.centre[2]).alias("_h"), finite(weight).alias("_weight"))
    rows = rows.select(*keys, "_h", "_weight", *[(r * F.col("_a") + d * F.col("_b") + f).alias(f"_{n}") for n, (r, d, f) in zip("xyz", camera.axes, strict=True)])
    reach = {"": (0.0, 0.0), "u": (half, 0.0), "v": (0.0, half)}
    toward = lambda n, p: F.col(f"_{n}") + sum(s * c for s, c in zip(reach[p], camera.axes["xyz".index(n)], strict=False))
    rows = rows.select("*", *[(F.col("_h") / F.nullif(toward("z", p), F.lit(0.0))).alias(f"_t{p}") for p in reach])
    # Places on the plane, about the point below the camera: clouds lie within some kilometres of it, so that squares keep their digits.
    rows = rows.select(*keys, "_weight", *[F.when(F.col(f"_t{p}") > 0, F.col(f"_t{p}") * toward(n, p)).alias(f"_{n}{p}") for n in "xy" for p in reach])
    area = 4 * F.abs((F.col("_xu") - F.col("_x")) * (F.col("_yv") - F.col("_y")) - (F.col("_yu") - F.col("_y")) * (F.col("_xv") - F.col("_x")))
    rows = rows.select(*keys, "_x", "_y", (F.col("_weight") * area).alias("_w")).select(*keys, "_x", "_y", F.when(F.col("_w") > 0, F.col("_w")).alias("_w"))
    x, y, w = F.col("_x"), F.col("_y"), F.col("_w")
    sums = rows.groupBy(*keys).agg(F.count(w).alias("n_used"), F.sum(w).alias("_m"), *[F.sum(w * e).alias(n) for e, n in ((x, "_sx"), (y, "_sy"), (x * x, "_sxx"), (y * y, "_syy"), (x * y, "_sxy"))]).filter(F.col("n_used") >= least)
    mx, my = F.col("_sx") / F.col("_m"), F.col("_sy") / F.col("_m")
    m = sums.select(*keys, "n_used", (mx + camera.centre[0]).alias("mean_u"), (my + camera.centre[1]).alias("mean_v"), *[(F.col(s) / F.col("_m") - p).alias(n) for s, p, n in (("_sxx", mx * mx, "var_u"), ("_syy", my * my, "var_v"), ("_sxy", mx * my, "cov_uv"))])
    major, minor = eigenvalues(F.col("var_u"), F.col("var_v"), F.col("cov_uv"))
    azimuth = F.pmod(90 - axis_of(F.col("var_u"), F.col("var_v"), F.col("cov_uv")), F.lit(180.0))
    root = lambda s: F.sqrt(F.greatest(s, F.lit(0.0)))
    return m.select(*keys, "n_used", F.col("mean_u").alias("east"), F.col("mean_v").alias("north"), root(major).alias("major"), root(minor).alias("minor"), azimuth.alias("azimuth"))


def principal_axis(df: DataFrame, keys: list[str], fx: str, fy: str) -> DataFrame:
    """Per key, the principal axis (ax, ay) of a vector field, turned towards its mean, and the number of finite vectors."""
    rows = df.select(*keys, finite(F.col(fx)).alias("_x"), finite(F.col(fy)).alias("_y")).dropna(subset=["_x", "_y"])
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.var_samp("_x").alias("sxx"), F.var_samp("_y").alias("syy"), F.covar_samp("_x", "_y").alias("sxy"))
    g = F.radians(axis_of(F.col("sxx"), F.col("syy"), F.col("sxy")))
    side = F.when(F.cos(g) * F.col("mx") + F.sin(g) * F.col("my") < 0, -1.0).otherwise(1.0)
    return s.select(*keys, "n", (side * F.cos(g)).alias("ax"), (side * F.sin(g)).alias("ay"))


def projected_speed(df: DataFrame, keys: list[str], fx: str, fy: str, gap: Column) -> DataFrame:
    """Per key, ``principal_axis`` and the median flow along it over ``gap`` (constant within a key)."""
    axes = principal_axis(df, keys, fx, fy)
    along = df.select(*keys, F.col(fx).alias("_x"), F.col(fy).alias("_y"), gap.alias("_gap")).join(axes.hint("shuffle_hash"), keys)  # the field is not sorted for it
    gaps = along.groupBy(*keys).agg(F.max("_gap").alias("_gap"))
    speed = quantiles(along, keys, F.col("_x") * F.col("ax") + F.col("_y") * F.col("ay"), [0.5], ["speed"])
    return speed.join(axes, keys).join(gaps, keys).select(*keys, "ax", "ay", (F.col("speed") / F.col("_gap")).alias("speed"))


def level_radii(df: DataFrame, keys: list[str], level: str, x: str, y: str, first: tuple[float, float], second: tuple[float, float], least: int = 3) -> DataFrame:
    """Per key and level, the radius and centre of what two views see: half the lesser of the ranges along two normals, and the point in the middle of both."""
    a, b = first[0] * F.col(x) + first[1] * F.col(y), second[0] * F.col(x) + second[1] * F.col(y)
    g = df.groupBy(*keys, level).agg(F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"), F.count("*").alias("n")).filter(F.col("n") >= least)
    det = first[0] * second[1] - first[1] * second[0]
    p, q = (F.col("a0") + F.col("a1")) / 2, (F.col("b0") + F.col("b1")) / 2
    return g.select(*keys, level, (F.least(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")) / 2).alias("radius"), ((second[1] * p - first[1] * q) / det).alias("x"), ((first[0] * q - second[0] * p) / det).alias("y"))


def pooled_spread(df: DataFrame, keys: list[str], angle: Column, cover: float = 0.9) -> DataFrame:
    """Per key, a von Mises fit of all angles (degrees) together and the span around its mean that holds ``cover`` of them."""
    from skyplume.functions import circular as C

    rows = df.select(*keys, finite(angle).alias("_a")).filter("_a is not null")
    mu, kappa, r = C.von_mises(F.col("_a"), F.lit(True), 1)
    fit = rows.groupBy(*keys).agg(mu.alias("mu"), kappa.alias("kappa"), r.alias("resultant"))
    span = quantiles(rows.join(fit, keys), keys, C.difference(F.col("_a"), F.col("mu")), [(1 - cover) / 2, (1 + cover) / 2], ["low", "high"])
    return fit.join(span, keys).withColumn("sigma", F.when(F.col("kappa") > 0, F.degrees(1 / F.sqrt("kappa"))))


def radial_rings(df: DataFrame, keys: list[str], x: Column, y: Column, rings: int, reach: float, population: DataFrame, at_least: float) -> DataFrame:
    """Per key and ring around the origin: rows, their share of the ring's ``population`` (ring, pixels), and whether that is ``at_least`` times the share over all rings."""
    ring = F.least(F.greatest(F.floor(F.sqrt(x * x + y * y) / reach * rings).cast("int"), F.lit(0)), F.lit(rings - 1))
    per = df.groupBy(*keys, ring.alias("ring")).agg(F.count("*").alias("n"))
    total = per.groupBy(*keys).agg(F.sum("n").alias("_n"))
    everywhere = population.agg(F.sum("pixels").alias("_pixels"))
    rows = per.join(F.broadcast(population.filter(F.col("ring") < rings)), "ring", "left").join(total, keys).join(F.broadcast(everywhere))
    share = F.col("n") / F.greatest(F.coalesce("pixels", F.lit(1)), F.lit(1))
    return rows.select(*keys, "ring", "n", share.alias("share"), (share >= at_least * F.greatest(F.col("_n") / F.col("_pixels"), F.lit(1e-6))).alias("bright"))


def concentration_series(clouds: DataFrame, keys: list[str], mass: Column, height: Column, laws: dict[str, tuple[Column, Column, Column]], t_end: Column, receptor: float = 1.5, n: int = 400) -> DataFrame:
    """(keys, i, t, cloud, receptor): concentration in the middle of each row's puff at ``n`` times that grow by a constant factor, at the cloud's height and at the receptor's.

    ``laws``: (s0, k, alpha) of the growth along, across and up ("along", "across", "up"), measured
    until ``t_end`` and carried on in a line. Times go from a 200th of ``t_end`` (0.05 at
    least) to ten times it (150 at least).
    """
    from skyplume.functions import physics as P

    first, last = F.greatest(t_end / 200, F.lit(0.05)), F.greatest(10 * t_end, F.lit(150.0))
    parts = {f"_{name}{i}": c for name, law in laws.items() for i, c in enumerate(law)}
    rows = clouds.select(*keys, first.alias("_f"), last.alias("_l"), t_end.alias("_e"), mass.alias("_m"), height.alias("_h"), *[c.alias(a) for a, c in parts.items()])
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("_f") * F.pow(F.col("_l") / F.col("_f"), F.col("i") / F.lit(float(n - 1))))
    sigma = {name: P.grown_sigma(F.col("t"), *[F.col(f"_{name}{i}") for i in range(3)], F.col("_e")) for name in laws}
    rows = rows.select(*keys, "i", "t", "_m", "_h", *[c.alias(f"_s{name}") for name, c in sigma.items()])
    at = lambda z: P.puff(F.col("_m"), F.lit(0.0), F.lit(0.0), z, F.col("_h"), F.col("_salong"), F.col("_sacross"), F.col("_sup"))
    return rows.select(*keys, "i", "t", at(F.col("_h")).alias("cloud"), at(F.lit(float(receptor))).alias("receptor"))
