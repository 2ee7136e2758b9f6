"""Hard negatives by exact scores, looked up in subset-sum tables.

The components of all vectors are whole numbers. A candidate is held as bit
planes: plane p has the bits 2 ** p of its components in two's complement, eight
dimensions to a byte. An anchor is held as tables: for each group of eight
dimensions, the sum of its components over each of the 256 subsets. A plane's
part of the inner product is one lookup a group, and the planes are added from
the sign down, shifting by one in between: a full exact score without a product.

The work goes in two rounds of tiles of bounded size, so that no label is held
whole however common it is: anchors against rows of their label for their
positives, then anchors, which know their positives' scores, against all rows
for the negatives. No pair is scored twice but for the few in the second round
that are of one label. Spark merges the tiles' picks, keeping no more than the
first of each list in a task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.llm.common import settled, tiled
from skyplume.llm.vectors import integers, score_type, tile_rows, whole

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies within these per cent of the positive's.
LOW, HIGH = 30, 90
#: Anchors and members whose tables and sums are in use together.
ANCHORS, STRIP = 16, 1024


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of whole numbers; the last plane is the sign's."""
    rows, dims = x.shape
    groups = -(-dims // 8)
    wide = np.zeros((rows, groups * 8), np.int64)
    wide[:, :dims] = x
    bits = max(int(x.max(initial=0)), -1 - int(x.min(initial=0)), 0).bit_length() + 1
    planes = [np.packbits((wide >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(bits)]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): sums of the anchors' components over the subsets of each eight dimensions."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), kind)
    wide[:, :dims] = anchors
    out = np.zeros((groups, 256, n), kind)
    for k in range(8):
        out[:, 1 << k : 2 << k] = out[:, : 1 << k] + wide[:, k::8].T[:, None, :]
    return out


def scores(anchors: np.ndarray, members: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor, scores) for some anchors at a time, a row of scores for each."""
    kind = score_type(anchors, members)
    planes = bit_planes(members)
    for at in range(0, len(anchors), ANCHORS):
        tables = subset_sums(anchors[at : at + ANCHORS], kind)
        out = np.zeros((len(members), tables.shape[2]), kind)
        for lo in range(0, len(members), STRIP):
            sums, strip = out[lo : lo + STRIP], planes[:, :, lo : lo + STRIP]
            for p in range(len(planes) - 1, -1, -1):
                sums <<= 1
                for g in range(len(tables)):
                    part = np.take(tables[g], strip[p, g], axis=0)
                    if p == len(planes) - 1:  # the sign's plane counts below zero
                        sums -= part
                    else:
                        sums += part
        yield at, np.ascontiguousarray(out.T)


def first_in_order(line: np.ndarray) -> np.ndarray:
    """Columns by falling score, ties in order."""
    return np.argsort(-line.astype(np.int64), kind="stable")


def laid_out(table: pa.Table, scale: int):
    """The tile in order of ties, its whole numbers, its home rows and its members."""
    table = table.sort_by([("vec_id", "ascending"), ("rid", "ascending")])  # nulls last
    role = table.column("role").to_numpy()
    return table, integers(table.column("embedding"), scale), np.flatnonzero(role & 1), np.flatnonzero(role & 2)


def tile_positives(table: pa.Table, k: int, scale: int) -> pa.Table:
    """(anchor_rid, rid, vec_id, score): for each anchor of the tile the ``k`` members that come first, itself apart."""
    table, x, home, member = laid_out(table, scale)
    rid = table.column("rid").to_numpy()
    left, right, score = [], [], []
    for at, lines in scores(x[home], x[member]):
        for i, line in enumerate(lines, at):
            order = first_in_order(line)[: k + 1]
            order = order[rid[member[order]] != rid[home[i]]][:k]
            left.append(np.full(len(order), home[i]))
            right.append(member[order])
            score.append(line[order].astype(np.int64))
    left, right, score = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (left, right, score))
    return pa.table({"anchor_rid": rid[left], "rid": rid[right], "vec_id": table.column("vec_id").combine_chunks().take(pa.array(right)), "score": score})


def tile_negatives(table: pa.Table, k: int, scale: int, low: int, high: int) -> pa.Table:
    """(anchor_rid, anchor_id, place, positive_id, positive_score, rid, negative_id, negative_score): for each anchor and positive the ``k`` members that come first."""
    table, x, home, member = laid_out(table, scale)
    rid, ids = table.column("rid").to_numpy(), table.column("vec_id").to_pylist()
    label = np.unique(np.array(table.column("label").to_pylist(), object).astype(str), return_inverse=True)[1]
    positives = table.column("positives").to_pylist()
    out = []
    for at, lines in scores(x[home], x[member]):
        for i, line in enumerate(lines, at):
            a = home[i]
            apart = np.flatnonzero(label[member] != label[a])
            apart = apart[first_in_order(line[apart])]
            falling = -line[apart].astype(np.int64)
            for place, p in enumerate(positives[a]):
                # 100 * score from low to high times the positive's
                lo, hi = -(-low * p["score"] // 100), high * p["score"] // 100
                first = int(np.searchsorted(falling, -hi))
                for c in apart[first : first + k].tolist():
                    if line[c] < lo:
                        break
                    m = member[c]
                    out.append((int(rid[a]), ids[a], place, p["vec_id"], p["score"], int(rid[m]), ids[m], int(line[c])))
    names = ("anchor_rid", "anchor_id", "place", "positive_id", "positive_score", "rid", "negative_id", "negative_score")
    columns = list(zip(*out, strict=True)) or [()] * len(names)
    return pa.table({name: pa.array(v, pa.int64()) for name, v in zip(names, columns, strict=True)})


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, low: int = LOW, high: int = HIGH, tile: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, embedding, label) where ``is_anchor`` holds.

    A component x counts as floor(scale * x), a score is the inner product; higher
    ones come first, ties by smaller vec_id, a null one last. An anchor's positives
    are its first other rows of its label; for each of them come the first rows
    of other labels whose score lies within ``low`` to ``high`` per cent of the
    positive's (none below a positive score of 0). Rows without label, without
    vector or with a null or non-finite component take no part. A vector that ends
    before another has zeros there, so an empty one scores 0. Each row counts by
    itself, those repeated with the same vec_id too. Fewer than asked for are all
    returned; an empty table gives no rows; labels may be of any type that has
    a text; other columns are not read. Components of 31 bits or more after
    scaling raise an error.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = settled(rows.filter(F.col("label").isNotNull() & whole(F.col("embedding"))).withColumn("rid", F.monotonically_increasing_id()))
    tile = tile or tile_rows(rows)
    # Labels without an anchor are left out; the others' anchors meet their rows.
    near = rows.join(rows.filter("anchor").select("label").distinct(), "label", "left_semi")
    picked = tiled(near, ["label"], "anchor", "rid", tile).groupBy("label", "hb", "mb").applyInArrow(lambda t: tile_positives(t, positives, scale), "anchor_rid long, rid long, vec_id long, score long")
    order = lambda *by: W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    picked = picked.withColumn("place", F.row_number().over(order("anchor_rid"))).filter(F.col("place") <= positives)
    # A few positives an anchor.
    known = picked.groupBy("anchor_rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))), lambda p: F.struct(p["vec_id"].alias("vec_id"), p["score"].alias("score"))).alias("positives"))
    every = rows.join(known, F.col("rid") == F.col("anchor_rid"), "left").drop("anchor_rid").withColumns({"anchor": F.col("positives").isNotNull(), "every": F.lit(0)})
    kinds = "anchor_rid long, anchor_id long, place long, positive_id long, positive_score long, rid long, negative_id long, negative_score long"
    found = tiled(settled(every), ["every"], "anchor", "rid", tile).groupBy("hb", "mb").applyInArrow(lambda t: tile_negatives(t, negatives, scale, low, high), kinds)
    rank = F.row_number().over(W.partitionBy("anchor_rid", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "rid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", noisy.alias("label")), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, c.rid AS c, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.rid <> c.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, anchor_id, c AS p, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id NULLS LAST, c) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, other_id NULLS LAST, c) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, other_id NULLS LAST, c) <= 10
"""
