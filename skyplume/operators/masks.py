"""Masks as pixel tables: (frame, v, u) for the pixels that are on."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixels(df: DataFrame, frame: str, values: str, width: int, on: Column) -> DataFrame:
    """Pixel table of arrays laid out by rows; ``on`` is a predicate on ``value``."""
    rows = df.select(F.col(frame).alias("frame"), F.posexplode(values).alias("i", "value")).filter(on)
    return rows.select("frame", F.floor(F.col("i") / width).cast("int").alias("v"), (F.col("i") % width).cast("int").alias("u"), "value")


def moments(px: DataFrame, height: int, width: int) -> DataFrame:
    """Area, centroid, population second moments and the share of border contact per frame."""
    edge = (F.col("u") == 0) | (F.col("u") == width - 1) | (F.col("v") == 0) | (F.col("v") == height - 1)
    return px.groupBy("frame").agg(
        F.count("*").alias("area"), F.avg("u").alias("mean_u"), F.avg("v").alias("mean_v"), F.var_pop("u").alias("var_u"), F.var_pop("v").alias("var_v"),
        F.covar_pop("u", "v").alias("cov_uv"), (F.count_if(edge) / (2 * (height + width))).alias("border"),
    )


def overlap(a: DataFrame, b: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """IoU and Dice per frame of two pixel tables; a frame in only one has 0.

    Frames of ``frames`` (frame) that have no pixel in either table are empty on
    both sides and agree: 1.
    """
    both = a.select("frame", "v", "u", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("frame", "v", "u", F.lit(0), F.lit(1)))
    per = both.groupBy("frame", "v", "u").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    inter = F.sum(F.col("x") * F.col("y"))
    found = per.groupBy("frame").agg((inter / F.count("*")).alias("iou"), (2 * inter / (F.sum("x") + F.sum("y"))).alias("dice"))
    if frames is None:
        return found
    return frames.select("frame").distinct().join(found, "frame", "left").fillna(1.0, ["iou", "dice"])


def vote(px: DataFrame, group: str, n: DataFrame) -> DataFrame:
    """Pixels that are on in half of a group's frames or more; ``n`` has the frames of each group (n_frames)."""
    return px.groupBy(group, "v", "u").agg(F.count("*").alias("votes")).join(n, group).filter(F.col("votes") >= F.ceil(F.col("n_frames") / 2)).select(group, "v", "u", "votes")


def ellipse(reach: int) -> list[tuple[int, int]]:
    """(down, across) of the steps of a disc drawn row by row: half a row's width is the root of what the height leaves, halves to even."""
    half = {dv: round(math.sqrt(reach * reach - dv * dv)) for dv in range(-reach, reach + 1)}
    return [(dv, du) for dv, n in half.items() for du in range(-n, n + 1)]


def dilate(px: DataFrame, reach: int, height: int, width: int, shape: str = "box") -> DataFrame:
    """Pixels within a box or an ellipse of ``reach`` of one that is on: an explode and a distinct, no inequality join."""
    if shape not in ("box", "ellipse"):
        raise ValueError(f"shape is 'box' or 'ellipse', not {shape!r}")
    near = ellipse(reach) if shape == "ellipse" else [(dv, du) for dv in range(-reach, reach + 1) for du in range(-reach, reach + 1)]
    steps = F.array(*[F.struct(F.lit(dv).alias("dv"), F.lit(du).alias("du")) for dv, du in near])
    grown = px.select("frame", "v", "u", F.explode(steps).alias("d")).select("frame", (F.col("v") + F.col("d.dv")).alias("v"), (F.col("u") + F.col("d.du")).alias("u"))
    return grown.filter(F.col("v").between(0, height - 1) & F.col("u").between(0, width - 1)).distinct()


def component_labels(points: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """For integer ``points`` (rows), the index of the first row that each one's component has; neighbours are ``steps`` apart.

    Neighbours are looked up by binary search, and labels are halved towards the
    smallest until none changes.
    """
    low = points.min(axis=0) - 1
    shape = points.max(axis=0) - low + 2
    code = np.ravel_multi_index((points - low).T, shape)
    order = np.argsort(code, kind="stable")
    label = np.arange(len(points))
    left, right = [], []
    for step in steps:
        near = np.ravel_multi_index((points - low + step).T, shape)
        at = np.minimum(np.searchsorted(code, near, sorter=order), len(code) - 1)
        hit = code[order[at]] == near
        left.append(np.flatnonzero(hit))
        right.append(order[at[hit]])
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


#: Half of the neighbours of a pixel (8) and of a voxel (6); the other half is these turned round.
AROUND = np.array([(0, 1), (1, -1), (1, 0), (1, 1)])
FACES = np.array([(0, 0, 1), (0, 1, 0), (1, 0, 0)])


def largest_component(px: DataFrame) -> DataFrame:
    """(frame, n_components, largest): 8-neighbour components of each frame's pixels. A frame is bounded by its size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = component_labels(pdf[["v", "u"]].drop_duplicates().to_numpy(), AROUND)
        sizes = np.unique(label, return_counts=True)[1]
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "n_components": [len(sizes)], "largest": [sizes.max()]})

    return px.select("frame", "v", "u").groupBy("frame").applyInPandas(run, "frame long, n_components long, largest long")


def components_by_area(px: DataFrame) -> DataFrame:
    """(frame, component, area, v, u): 8-neighbour components of each frame, numbered by their first pixel in reading order, with their centroids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["v", "u"]].drop_duplicates().sort_values(["v", "u"], ignore_index=True)
        first, place = np.unique(component_labels(p.to_numpy(), AROUND), return_inverse=True)
        area = np.bincount(place)
        mean = [np.bincount(place, p[c]) / area for c in ("v", "u")]
        return pd.DataFrame({"frame": pdf["frame"].iloc[0], "component": np.arange(len(first)), "area": area, "v": mean[0], "u": mean[1]})

    return px.select("frame", "v", "u").groupBy("frame").applyInPandas(run, "frame long, component long, area long, v double, u double")


def seed_component(px: DataFrame, at: tuple[float, float], reach: float) -> DataFrame:
    """Per frame, the largest component whose centroid lies within ``reach`` of ``at`` (v, u); of equals the last in reading order."""
    near = components_by_area(px).filter(F.sqrt(F.pow(F.col("v") - at[0], 2) + F.pow(F.col("u") - at[1], 2)) <= reach)
    return near.groupBy("frame").agg(F.max(F.struct("area", "component")).alias("_b")).select("frame", "_b.component", "_b.area")


def largest_solid(voxels: DataFrame) -> DataFrame:
    """(frame, n_components, largest): 6-neighbour components of each frame's voxels (v, u, k)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        label = component_labels(pdf[["v", "u", "k"]].drop_duplicates().to_numpy(), FACES)
        sizes = np.unique(label, return_counts=True)[1]
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "n_components": [len(sizes)], "largest": [sizes.max()]})

    return voxels.select("frame", "v", "u", "k").groupBy("frame").applyInPandas(run, "frame long, n_components long, largest long")


def farthest_points(px: DataFrame, n: int) -> DataFrame:
    """(frame, rank, v, u): up to ``n`` pixels of each frame, each the farthest from those before; the first is nearest the centroid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["v", "u"])[["v", "u"]].to_numpy().astype(float)
        picked = [int(((p - p.mean(axis=0)) ** 2).sum(axis=1).round(9).argmin())]
        gap = ((p - p[picked[0]]) ** 2).sum(axis=1)
        while len(picked) < min(n, len(p)) and gap.max() > 0:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, ((p - p[picked[-1]]) ** 2).sum(axis=1))
        return pd.DataFrame({"frame": pdf["frame"].iloc[0], "rank": range(len(picked)), "v": p[picked, 0].astype(int), "u": p[picked, 1].astype(int)})

    return px.select("frame", "v", "u").groupBy("frame").applyInPandas(run, "frame long, rank int, v int, u int")


def carve(voxels: DataFrame, px: DataFrame) -> DataFrame:
    """Voxels (frame, v, u, k) whose pixel is on."""
    return voxels.join(px.select("frame", "v", "u"), ["frame", "v", "u"], "left_semi")


def fill_columns(voxels: DataFrame) -> DataFrame:
    """Each column (frame, v, u) filled from its lowest to its highest voxel."""
    ends = voxels.groupBy("frame", "v", "u").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    return ends.select("frame", "v", "u", F.explode(F.sequence("lo", "hi")).alias("k"))


def merged(*tables: DataFrame) -> DataFrame:
    """Union of pixel tables."""
    out = tables[0].select("frame", "v", "u")
    for t in tables[1:]:
        out = out.unionByName(t.select("frame", "v", "u"))
    return out.distinct()


def often_on(px: DataFrame, frames: DataFrame, share: float) -> DataFrame:
    """(v, u, share) of pixels that are on in ``share`` of ``frames`` (frame) or more."""
    n = frames.select("frame").distinct()
    inside = px.join(n, "frame", "left_semi").groupBy("v", "u").agg(F.count("*").alias("_n"))
    return inside.join(F.broadcast(n.agg(F.count("*").alias("_all")))).select("v", "u", (F.col("_n") / F.col("_all")).alias("share")).filter(F.col("share") >= share)


def evidence(px: DataFrame, shadow: Column, unknown: Column) -> DataFrame:
    """``px`` with ``evidence``: -1 unknown, 1 in the column's shadow, 0 lit ground; unknown comes first, and a null flag is false."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return px.withColumn("evidence", F.when(flag(unknown), -1).when(flag(shadow), 1).otherwise(0).cast("tinyint"))


def sunlit(voxels: DataFrame, evidence_px: DataFrame, strict: bool) -> DataFrame:
    """``voxels`` with ``free``: the ground that a voxel would shade (frame, v, u) is lit, or in the strict form merely not shaded; without evidence it is not free."""
    rows = voxels.join(evidence_px.select("frame", "v", "u", "evidence"), ["frame", "v", "u"], "left")
    test = F.col("evidence") != 1 if strict else F.col("evidence") == 0
    return rows.withColumn("free", F.coalesce(test, F.lit(False))).drop("evidence")


def carve_with_fallback(voxels: DataFrame, evidence_px: DataFrame, least_kept: float = 0.25, least_height: float = 0.6) -> DataFrame:
    """Per frame, what stays of the voxels (frame, v, u, k): carved strictly if enough stays, else permissively, else not at all.

    Enough: ``least_kept`` of the voxels and ``least_height`` of the 99 % quantile
    of k. (frame, mode, kept, n_voxels); a frame is bounded by its grid.
    """
    both = sunlit(voxels, evidence_px, True).withColumnRenamed("free", "strict")
    loose = sunlit(voxels, evidence_px, False).select("frame", "v", "u", "k", F.col("free").alias("loose"))
    rows = both.join(loose, ["frame", "v", "u", "k"])
    top = lambda c: F.percentile(F.when(~F.col(c), F.col("k")), F.lit(0.99)) if c else F.percentile("k", F.lit(0.99))
    g = rows.groupBy("frame").agg(F.count("*").alias("n_voxels"), F.count_if(~F.col("strict")).alias("ns"), F.count_if(~F.col("loose")).alias("nl"), top(None).alias("h"), top("strict").alias("hs"), top("loose").alias("hl"))
    ok = lambda n, h: (F.col(n) >= least_kept * F.col("n_voxels")) & F.coalesce(F.col(h) >= least_height * F.col("h"), F.lit(False))
    mode = F.when(ok("ns", "hs"), "strict").when(ok("nl", "hl"), "permissive").otherwise("no shadow")
    return g.select("frame", mode.alias("mode"), F.when(mode == "strict", F.col("ns")).when(mode == "permissive", F.col("nl")).otherwise(F.col("n_voxels")).alias("kept"), "n_voxels")


def consensus(px: DataFrame, variant: str, n: int) -> DataFrame:
    """Per frame, agreement of ``n`` variants' masks (frame, variant, v, u) with their majority: area, spread of areas, mean and least IoU, and the variant of the least.

    Frames that a variant lacks are left out.
    """
    whole = px.groupBy("frame").agg(F.countDistinct(variant).alias("_k")).filter(F.col("_k") == n).select("frame")
    rows = px.join(whole, "frame", "left_semi")
    votes = rows.groupBy("frame", "v", "u").agg(F.count("*").alias("_votes"))
    agreed = votes.filter(F.col("_votes") >= math.ceil(n / 2)).select("frame", "v", "u", F.lit(True).alias("_in"))
    size = agreed.groupBy("frame").agg(F.count("*").alias("area"))
    per = rows.join(agreed, ["frame", "v", "u"], "left").groupBy("frame", variant).agg(F.count("*").alias("_a"), F.count("_in").alias("_i"))
    per = per.join(size, "frame", "left").withColumn("area", F.coalesce("area", F.lit(0))).withColumn("_iou", F.col("_i") / (F.col("_a") + F.col("area") - F.col("_i")))
    return per.groupBy("frame", "area").agg((F.stddev_pop("_a") / F.avg("_a")).alias("cv_area"), F.avg("_iou").alias("mean_iou"), F.min("_iou").alias("least_iou"), F.min_by(variant, F.struct("_iou", variant)).alias("least_variant"))


def compared(truth: DataFrame, model: DataFrame, tolerance: int) -> DataFrame:
    """Each frame of ``truth`` against the nearest frame of ``model`` within ``tolerance``, ties to the lower: areas, false pixels and IoU.

    Both are pixel tables (frame, v, u).
    """
    a, b = truth.select("frame").distinct(), model.select(F.col("frame").alias("model_frame")).distinct()
    near = b.withColumn("frame", F.explode(F.sequence(F.col("model_frame") - tolerance, F.col("model_frame") + tolerance)))
    pairs = a.join(near, "frame").groupBy("frame").agg(F.min(F.struct(F.abs(F.col("frame") - F.col("model_frame")).alias("d"), "model_frame")).alias("_b")).select("frame", "_b.model_frame")
    mine = truth.select("frame", "v", "u").distinct().join(pairs, "frame").select("frame", "model_frame", "v", "u", F.lit(1).alias("x"), F.lit(0).alias("y"))
    other = model.select(F.col("frame").alias("model_frame"), "v", "u").distinct().join(pairs, "model_frame").select("frame", "model_frame", "v", "u", F.lit(0), F.lit(1))
    per = mine.union(other).groupBy("frame", "model_frame", "v", "u").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    inter = F.sum(F.col("x") * F.col("y"))
    return per.groupBy("frame", "model_frame").agg(
        F.sum("x").alias("true_area"), F.sum("y").alias("area"), (F.sum("y") / F.sum("x")).alias("ratio"), (F.sum("y") - inter).alias("false_pixels"), (F.sum("x") - inter).alias("missed"), (inter / F.count("*")).alias("iou"),
    )


def rectangles(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v, u) of pixels that any box (v0, u0, v1, u1, ends included) covers: each row's spans are unrolled, pixels in many boxes come once."""
    rows = boxes.select(*keys, "u0", "u1", F.explode(F.sequence("v0", "v1")).alias("v")).distinct()
    return rows.select(*keys, "v", F.explode(F.sequence("u0", "u1")).alias("u")).distinct()


def packed(px: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, h, w, bits): pixels as bits, by rows, the first pixel the highest bit; a frame is height * width / 8 bytes.

    Pixels beyond the frame are left out; a frame without pixels is not there.
    """

    def run(table: pa.Table) -> pa.Table:
        on = np.zeros(height * width, bool)
        on[table.column("v").to_numpy() * width + table.column("u").to_numpy()] = True
        return pa.table({"frame": table.column("frame").slice(0, 1), "h": pa.array([height], pa.int32()), "w": pa.array([width], pa.int32()), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    inside = px.select("frame", F.col("v").cast("long").alias("v"), F.col("u").cast("long").alias("u")).filter(F.col("v").between(0, height - 1) & F.col("u").between(0, width - 1))
    return inside.groupBy("frame").applyInArrow(run, f"frame {px.schema['frame'].dataType.simpleString()}, h int, w int, bits binary")


def unpacked(sets: DataFrame) -> DataFrame:
    """(frame, v, u) of the pixels that are on in ``packed`` rows."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                h, w = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                at = np.flatnonzero(np.unpackbits(np.frombuffer(b.column(3)[i].as_py(), np.uint8), count=h * w))
                frame = b.column(0).take(pa.array(np.full(len(at), i)))
                yield pa.RecordBatch.from_arrays([frame, pa.array(at // w, pa.int32()), pa.array(at % w, pa.int32())], ["frame", "v", "u"])

    return sets.select("frame", "h", "w", "bits").mapInArrow(run, f"frame {sets.schema['frame'].dataType.simpleString()}, v int, u int")


def polygon_pixels(polygons: DataFrame, keys: list[str], points: str, height: int, width: int) -> DataFrame:
    """(keys, v, u) of the pixels whose centres lie within a polygon (array of [x, y]) by the even-odd rule, row by row."""
    n = F.size(points)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.named_struct(F.lit("x0"), F.get(points, i)[0], F.lit("y0"), F.get(points, i)[1], F.lit("x1"), F.get(points, (i + 1) % n)[0], F.lit("y1"), F.get(points, (i + 1) % n)[1]))
    # Cut to 0 and ``most`` and rounded up: the first whole number that is not below.
    whole = lambda c, most: F.ceil(F.least(F.greatest(c, F.lit(0.0)), F.lit(float(most)))).cast("int")
    ys = F.transform(points, lambda p: p[1])
    rows = polygons.filter(n >= 3).select(*keys, edges.alias("_e"), whole(F.array_min(ys), height).alias("_low"), whole(F.array_max(ys), height).alias("_high")).filter("_low < _high")
    rows = rows.select(*keys, "_e", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("v"))
    y = F.col("v").cast("double")
    # An edge within a billionth of a pixel's centre runs through it.
    cut = F.transform(F.filter("_e", lambda e: (e["y0"] <= y) != (e["y1"] <= y)), lambda e: F.round(e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"]), 9))
    rows = rows.select(*keys, "v", F.transform(F.sort_array(cut, asc=False), lambda c: whole(c, width)).alias("_c")).filter(F.size("_c") > 0)
    # From the right, a row is inside from each second edge to the one before it.
    pairs = F.transform(F.sequence(F.lit(0), F.size("_c") - 1, F.lit(2)), lambda k: F.struct(F.coalesce(F.get("_c", k + 1), F.lit(0)).alias("a"), F.get("_c", k).alias("b")))
    rows = rows.select(*keys, "v", F.explode(F.filter(pairs, lambda p: p["a"] < p["b"])).alias("_p"))
    return rows.select(*keys, "v", F.explode(F.sequence(F.col("_p.a"), F.col("_p.b") - 1)).alias("u"))
