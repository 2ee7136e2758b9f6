"""A pinhole camera over a map plane (x east, y north, z up) as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation(yaw: float, pitch: float) -> np.ndarray:
    """Camera axes (right, down, forward) in world axes, from degrees: yaw from north clockwise, pitch up."""
    y, p = math.radians(yaw), math.radians(pitch)
    forward = np.array([math.sin(y) * math.cos(p), math.cos(y) * math.cos(p), math.sin(p)])
    right = np.array([math.cos(y), -math.sin(y), 0.0])
    return np.stack([right, np.cross(forward, right), forward], axis=1)


@dataclass(frozen=True)
class Camera:
    """Focal length and principal point in pixels, axes and centre in the world, frame size."""

    focal: float
    cx: float
    cy: float
    axes: tuple[tuple[float, float, float], ...]
    centre: tuple[float, float, float]
    width: int
    height: int

    @staticmethod
    def at(focal: float, centre: tuple[float, float, float], yaw: float, pitch: float, width: int, height: int) -> Camera:
        return Camera(focal, width / 2, height / 2, tuple(map(tuple, rotation(yaw, pitch).tolist())), centre, width, height)

    def ray(self, u: Column, v: Column) -> list[Column]:
        """World direction of unit length through a pixel."""
        x, y = (u - self.cx) / self.focal, (v - self.cy) / self.focal
        n = F.sqrt(x * x + y * y + 1)
        return [(a[0] * x + a[1] * y + a[2]) / n for a in self.axes]

    def on_plane(self, u: Column, v: Column, z: Column) -> tuple[Column, Column]:
        """(x, y) where a pixel's ray meets the plane at height ``z``; null if it does not, ahead of the camera."""
        d = self.ray(u, v)
        t = (z - self.centre[2]) / F.nullif(d[2], F.lit(0.0))
        return tuple(F.when(t > 0, self.centre[k] + t * d[k]) for k in range(2))

    def depth(self, x: Column, y: Column, z: Column) -> Column:
        return sum((a[2] * (p - c) for a, p, c in zip(self.axes, (x, y, z), self.centre, strict=True)), F.lit(0.0))

    def pixel(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        """(u, v) of a point; null if it is not ahead of the camera."""
        part = lambda k: sum((a[k] * (p - c) for a, p, c in zip(self.axes, (x, y, z), self.centre, strict=True)), F.lit(0.0))
        ahead = F.when(part(2) > 1e-9, part(2))
        return self.focal * part(0) / ahead + self.cx, self.focal * part(1) / ahead + self.cy

    def in_frame(self, u: Column, v: Column) -> Column:
        """Whether the pixel that (u, v) rounds to, half to even, lies in the frame; false where there is none."""
        return F.coalesce(F.rint(u).between(0, self.width - 1) & F.rint(v).between(0, self.height - 1), F.lit(False))

    def scale(self, u: Column, v: Column, z: Column, eps: float = 2.0) -> tuple[Column, Column]:
        """Metres of the plane per pixel along u and v."""
        x, y = self.on_plane(u, v, z)
        out = []
        for du, dv in ((eps, 0.0), (0.0, eps)):
            a, b = self.on_plane(u + du, v + dv, z)
            out.append(F.sqrt(F.pow(a - x, 2) + F.pow(b - y, 2)) / eps)
        return tuple(out)


def box_span(origin: list[Column], direction: list[Column], low: list[float], high: list[float]) -> tuple[Column, Column]:
    """Where a ray enters and leaves a box along its length (entry 0 if it starts inside); both null if it misses."""
    near, far = [], []
    for o, d, lo, hi in zip(origin, direction, low, high, strict=True):
        a, b = (lo - o) / F.nullif(d, F.lit(0.0)), (hi - o) / F.nullif(d, F.lit(0.0))
        inside = (o >= lo) & (o <= hi)
        near.append(F.when(d == 0, F.when(inside, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.least(a, b)))
        far.append(F.when(d == 0, F.when(inside, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.greatest(a, b)))
    start, stop = F.greatest(*near, F.lit(0.0)), F.least(*far)
    return F.when(stop > start, start), F.when(stop > start, stop)
