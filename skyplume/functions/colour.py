"""Colours of pixels as column expressions: 8-bit channels 0 to 255 in, 8-bit scales out, without rounding in between.

Channels beyond the range are held to it. Scales: lightness 0 to 255, hue 0 to 180,
saturation and value 0 to 255, red difference about 128.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in luminance (linear) and in luma (as stored).
LUMINANCE = (0.212671, 0.715160, 0.072169)
LUMA = (0.299, 0.587, 0.114)
#: Fixed value: scale of the red difference.
RED_SCALE = 0.713


def held(level: Column) -> Column:
    return F.least(F.greatest(level, F.lit(0.0)), F.lit(255.0))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return sum((w * c for w, c in zip(LUMA, (red, green, blue), strict=True)), F.lit(0.0))


def linear(level: Column) -> Column:
    """Light of a stored level, 0 to 1."""
    c = held(level) / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def lightness(red: Column, green: Column, blue: Column) -> Column:
    """Perceived lightness, 0 to 255."""
    y = sum((w * linear(c) for w, c in zip(LUMINANCE, (red, green, blue), strict=True)), F.lit(0.0))
    return 2.55 * F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)


def hsv(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value; a grey has hue 0, black saturation 0."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = F.nullif(top - low, F.lit(0.0))
    hue = F.when(top == red, 30 * (green - blue) / span).when(top == green, 60 + 30 * (blue - red) / span).otherwise(120 + 30 * (red - green) / span)
    hue = F.coalesce(F.when(hue < 0, hue + 180).otherwise(hue), F.lit(0.0))
    return hue, F.coalesce(255 * (top - low) / F.nullif(top, F.lit(0.0)), F.lit(0.0)), top * 1.0


def from_hsv(hue: Column, saturation: Column, value: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue."""
    sector, s = hue / 30.0, saturation / 255.0
    channel = lambda shift: value * (1 - s * F.greatest(F.lit(0.0), F.least(F.pmod(sector + shift, F.lit(6.0)), 4 - F.pmod(sector + shift, F.lit(6.0)), F.lit(1.0))))
    return channel(5.0), channel(3.0), channel(1.0)


def red_difference(red: Column, green: Column, blue: Column) -> Column:
    return (red - luma(red, green, blue)) * RED_SCALE + 128


def balanced(rgb: tuple[Column, Column, Column], gains: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """Channels times their gains."""
    return tuple(held(c * g) for c, g in zip(rgb, gains, strict=True))


def saturated(rgb: tuple[Column, Column, Column], factor: float) -> tuple[Column, Column, Column]:
    hue, s, v = hsv(*rgb)
    return from_hsv(hue, held(s * factor), v)
