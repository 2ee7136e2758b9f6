"""Circular statistics as column expressions; angles in degrees. Rows whose angle or weight is null, NaN or infinite do not count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyplume.functions.guards import finite


def sin_deg(angle: Column) -> Column:
    return F.sin(F.radians(angle))


def cos_deg(angle: Column) -> Column:
    return F.cos(F.radians(angle))


def turned(angle: Column) -> Column:
    """``angle`` in [0, 360); what lies below 360 by less than the last digits of a full turn is 0."""
    return (angle % 360.0 + 360.0) % 360.0


def angle_of(s: Column, c: Column) -> Column:
    """The direction of (c, s) in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))


def _parts(angle: Column, weight: Column | None) -> tuple[Column, Column, Column]:
    """Sums of weight, weighted sine and weighted cosine."""
    a = finite(angle)
    w = F.when(a.isNotNull(), F.lit(1.0) if weight is None else finite(weight))
    return F.sum(w), F.sum(w * sin_deg(a)), F.sum(w * cos_deg(a))


def circular_mean(angle: Column, weight: Column | None = None) -> Column:
    """Aggregate: mean direction, weighted if ``weight`` is given; null where no row counts."""
    _, s, c = _parts(angle, weight)
    return angle_of(s, c)


def resultant(angle: Column, weight: Column | None = None) -> Column:
    """Aggregate: length of the weighted mean unit vector, 0..1."""
    w, s, c = _parts(angle, weight)
    return F.sqrt(s * s + c * c) / F.nullif(w, F.lit(0.0))


def circular_spread(angle: Column, weight: Column | None = None) -> Column:
    """Aggregate: circular standard deviation in degrees; null where no row counts."""
    r = resultant(angle, weight)
    return F.when(r.isNotNull(), F.degrees(F.sqrt(F.greatest(-2 * F.ln(F.greatest(r, F.lit(1e-12))), F.lit(0.0)))))


def von_mises(angle: Column, nonzero: Column, least: int = 10) -> tuple[Column, Column, Column]:
    """Aggregates mu (degrees in (-180, 180]), kappa and the resultant of rows that are ``nonzero``; null for fewer than ``least`` rows."""
    a = F.when(nonzero, finite(angle))
    n, c, s = F.count(a), F.avg(cos_deg(a)), F.avg(sin_deg(a))
    r = F.least(F.sqrt(c * c + s * s), F.lit(1 - 1e-12))
    enough = n >= least
    return F.when(enough, F.degrees(F.atan2(s, c))), F.when(enough, r * (2 - r * r) / (1 - r * r)), F.when(enough, r)


def difference(a: Column, b: Column) -> Column:
    """a - b in [-180, 180); a half turn but for the last digits of doubles is one back, whichever side of it they lie on."""
    return turned(a - b + 180.0) - 180.0
