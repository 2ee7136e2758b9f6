"""Spreads in the wind's frame with the cloud's own height taken out: the right plane, then a fixed point of width and height.

Rows are moments of a cloud on a plane: see, snn, sen (covariance, east and
north) and east, north (centre). What a camera that looks aslant sees of a cloud's height lies
along its line of sight and widens the moments; how much depends on the
vertical spread, which is known as a ratio of the width across the wind. So both
are found together, a few rounds from the width as seen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.functions.camera import Camera
from skyplume.operators.fits import directional_sigma


def on_right_plane(rows: DataFrame, camera: Camera, z_floor: float, used: str, up: str) -> DataFrame:
    """``rows`` as if they had been mapped to the plane ``up`` over the floor instead of the one at height ``used``: lengths about the point below the camera change by one factor, ``factor``."""
    tall = camera.centre[2] - z_floor
    f = (tall - F.col(up)) / F.greatest(tall - (F.col(used) - z_floor), F.lit(1e-6))
    moved = lambda c, k: camera.centre[k] + f * (F.col(c) - camera.centre[k])
    return rows.withColumns({"see": F.col("see") * f * f, "snn": F.col("snn") * f * f, "sen": F.col("sen") * f * f, "east": moved("east", 0), "north": moved("north", 1), used: z_floor + F.col(up), "factor": f})


def sight(camera: Camera, azimuth: float) -> tuple[float, float, float]:
    """Tangent of the camera's angle from the nadir, and the shares of what it adds along the wind and across it."""
    d = [a[2] for a in camera.axes]
    theta = math.acos(min(1.0, max(-1.0, -d[2])))
    phi = math.radians(abs((azimuth - math.degrees(math.atan2(d[0], d[1])) + 90) % 180 - 90))
    return math.tan(theta), abs(math.cos(phi)), abs(math.sin(phi))


def discounted(spread: Column, vertical: Column, tangent: float, share: float) -> Column:
    """``spread`` without what the vertical spread adds to it; a thousandth at least."""
    return F.sqrt(F.greatest(spread * spread - F.pow(vertical * tangent * share, 2), F.lit(1e-6)))


def refined(rows: DataFrame, keys: list[str], camera: Camera, azimuth: float, ratio: str, times: int = 4, eps: float = 1e-4) -> DataFrame:
    """``rows`` with along, across, vertical, ``rounds`` and ``change``: the wind-frame spreads at rest.

    In each round the widths are discounted by the vertical spread of the one before,
    and the vertical spread is ``ratio`` times the new width across. A key ends at the first
    round in which none of its rows changes by ``eps``, after ``times`` rounds at the latest; ``change`` is
    its largest one then.
    """
    tangent, on_along, on_across = sight(camera, azimuth)
    along, across = directional_sigma(F.col("see"), F.col("snn"), F.col("sen"), azimuth)
    rows = rows.withColumns({"_al": along, "_cr": across})
    step = lambda z: F.col(ratio) * discounted(F.col("_cr"), z, tangent, on_across)
    start = F.array(F.col(ratio) * F.col("_cr"))
    # All rounds of a row, then the round at which its key comes to rest.
    path = F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda acc, _: F.concat(acc, F.array(step(F.element_at(acc, -1)))))
    rows = rows.withColumn("_z", path)
    key = W.partitionBy(*keys)
    moves = F.array(*[F.max(F.abs(F.col("_z")[k] - F.col("_z")[k - 1])).over(key) for k in range(1, times + 1)])
    rows = rows.withColumn("_moves", moves)
    still = F.filter(F.transform("_moves", lambda m, i: F.when(m < eps, i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("rounds", F.coalesce(F.get(still, F.lit(0)), F.lit(times)).cast("int"))
    before = F.element_at("_z", F.col("rounds"))
    out = rows.withColumns({"along": discounted(F.col("_al"), before, tangent, on_along), "across": discounted(F.col("_cr"), before, tangent, on_across), "vertical": F.element_at("_z", F.col("rounds") + 1), "change": F.element_at("_moves", F.col("rounds"))})
    return out.drop("_al", "_cr", "_z", "_moves")
