"""Closed forms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_profile(speed: Column, z: float, z_ref: float, z0: float) -> Column:
    """Wind speed at height ``z`` from that at ``z_ref`` over roughness ``z0``."""
    return speed * (math.log(z / z0) / math.log(z_ref / z0))


def sound_speed(celsius: Column) -> Column:
    return 331.3 * F.sqrt(1 + celsius / 273.15)


def puff(q: Column, x: Column, y: Column, z: Column, height: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """Concentration of a Gaussian puff of mass ``q``, reflected at the ground; x and y from its centre."""
    bell = lambda d, s: F.exp(-(d * d) / (2 * s * s))
    return q / ((2 * math.pi) ** 1.5 * sx * sy * sz) * bell(x, sx) * bell(y, sy) * (bell(z - height, sz) + bell(z + height, sz))


def sigmoid(x: Column, centre: float, slope: float) -> Column:
    return 1 / (1 + F.exp(F.least(F.greatest(-slope * (x - centre), F.lit(-60.0)), F.lit(60.0))))


def regime(alpha: Column) -> Column:
    """What a growth law's exponent says."""
    return F.when(alpha < 1.3, "fickian").when(alpha < 2.3, "superdiffusive").otherwise("richardson")


def sun(days: Column, latitude: float, longitude: float) -> tuple[Column, Column]:
    """Azimuth (degrees from north, clockwise) and elevation of the sun, ``days`` after 2000-01-01 12:00 UTC.

    Low-precision almanac series: mean longitude and anomaly give the ecliptic
    longitude, obliquity turns it to right ascension and declination, sidereal
    time gives the hour angle.
    """
    turn = lambda x: F.radians(F.pmod(x, F.lit(360.0)))
    # The almanac's coefficients.
    anomaly = turn(357.529 + 0.98560028 * days)
    ecliptic = turn(F.pmod(280.459 + 0.98564736 * days, F.lit(360.0)) + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(23.439 - 0.00000036 * days)
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.pmod(18.697374558 + 24.06570982441908 * days, F.lit(24.0))
    hour = turn(sidereal * 15 + longitude) - ascension
    sin_lat, cos_lat = math.sin(math.radians(latitude)), math.cos(math.radians(latitude))
    elevation = F.asin(sin_lat * F.sin(declination) + cos_lat * F.cos(declination) * F.cos(hour))
    azimuth = F.atan2(-F.cos(declination) * F.sin(hour), F.sin(declination) * cos_lat - F.cos(declination) * sin_lat * F.cos(hour))
    return F.pmod(F.degrees(azimuth), F.lit(360.0)), F.degrees(elevation)


def scattering(cos_angle: Column, g: float) -> Column:
    """Henyey-Greenstein phase function, 1 at g = 0; ``g`` is held to 0.9 either way."""
    g = min(max(g, -0.9), 0.9)
    return (1 - g * g) / F.pow(1 + g * g - 2 * g * cos_angle, F.lit(1.5))


def grown_sigma(t: Column, s0: Column, k: Column, alpha: Column, t_end: Column) -> Column:
    """sigma(t) of a growth law sigma^2 = s0 + k t^alpha up to ``t_end``, beyond it with sigma^2 going on in a line."""
    t = F.greatest(t, F.lit(0.0))
    inside = s0 + k * F.pow(t, alpha)
    beyond = s0 + k * F.pow(t_end, alpha) + k * alpha * F.pow(t_end, alpha - 1) * (t - t_end)
    return F.sqrt(F.greatest(F.when(t <= t_end, inside).otherwise(beyond), F.lit(1e-6)))


def toned(level: Column, gain: float = 1.0, offset: float = 0.0, gamma: float = 1.0) -> Column:
    """An 8-bit level with gain, offset and gamma, held to 0..255."""
    held = F.least(F.greatest(gain * level + offset, F.lit(0.0)), F.lit(255.0))
    return 255.0 * F.pow(held / 255.0, F.lit(1.0 / gamma))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue
