"""Exact search for the best inner products, by exhaustive term-at-a-time accumulation.

Vectors are rows of weighted terms (their dimensions). Queries meet all rows in
tiles of bounded size. In a tile the members' postings are built by term: the
rows that have it, with their values; each query's terms in turn scatter weight
times value into its dense array of scores (a term that most members have is
held as a whole column and added at one go). Of each array the best are picked
by partition selection, and Spark merges the tiles' picks by query, keeping no
more than the best of each query in a task before anything is shuffled.

Scores are exact: whole numbers in the narrowest integers that hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.llm.common import settled, tiled
from skyplume.llm.vectors import integers, score_type, tile_rows, whole

SCALE, BEST = 64, 20
#: Queries whose scores are selected from together.
STRIP = 32


def postings(members: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """By term: the rows that have it and their values; None instead of rows that are more than half of all: then values are a whole column."""
    out = []
    for column in members.T:
        rows = np.flatnonzero(column)
        out.append((None, np.ascontiguousarray(column)) if 2 * len(rows) > len(column) else (rows, column[rows]))
    return out


def accumulate(query: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], scores: np.ndarray, room: np.ndarray) -> None:
    """Adds the inner products of ``query`` with all members to ``scores``; ``room`` is an array of the same kind."""
    for term in np.flatnonzero(query).tolist():
        rows, values = lists[term]
        if rows is None:
            np.add(scores, np.multiply(values, query[term], out=room), out=scores)
        else:
            scores[rows] += values * query[term]  # a member has a term once


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest of each row, ties to the smaller column."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((column, -scores[row, column].astype(np.int64), row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def tile_best(table: pa.Table, k: int, scale: int) -> pa.Table:
    """(query_rid, query_id, rid, vec_id, score): for each home row of the tile its ``k`` best members other than itself."""
    table = table.sort_by([("vec_id", "ascending"), ("rid", "ascending")])  # nulls last: columns are in order of ties
    role, rid = (table.column(c).to_numpy() for c in ("role", "rid"))
    x = integers(table.column("embedding"), scale)
    home, member = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    kind = score_type(x[home], x[member])
    x = x.astype(kind)
    lists, room = postings(x[member]), np.empty(len(member), kind)
    left, right, score = [], [], []
    for at in range(0, len(home), STRIP):
        some = home[at : at + STRIP]
        scores = np.zeros((len(some), len(member)), kind)
        for query, line in zip(x[some], scores, strict=True):
            accumulate(query, lists, line, room)
        row, column = best_of(scores, k + 1)  # the row itself may be among them
        left.append(some[row])
        right.append(member[column])
        score.append(scores[row, column].astype(np.int64))
    left, right, score = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (left, right, score))
    other = rid[left] != rid[right]
    left, right, score = left[other], right[other], score[other]
    ids = table.column("vec_id").combine_chunks()
    return pa.table({"query_rid": rid[left], "query_id": ids.take(pa.array(left)), "rid": rid[right], "vec_id": ids.take(pa.array(right)), "score": score})


def best_matches(vectors: DataFrame, is_query: Column, k: int = BEST, scale: int = SCALE, tile: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) where ``is_query`` holds, the ``k`` other rows of the greatest scores.

    A component x counts as floor(scale * x); the score is the inner product, ties
    go to the smaller vec_id, a null one last. Rows whose vector is null or holds a
    null or non-finite component take no part. A vector that ends before another
    has zeros there, so an empty one scores 0. Each row counts by itself: one
    repeated with the same vec_id is a candidate of its like, and a query as often as
    it is there. Fewer than ``k`` other rows are all returned; an empty table
    gives no rows; other columns are not read. Components of 31 bits or more after
    scaling raise an error.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = settled(rows.filter(whole(F.col("embedding"))).withColumns({"rid": F.monotonically_increasing_id(), "every": F.lit(0)}))
    tiles = tiled(rows, ["every"], "query", "rid", tile or tile_rows(rows))
    found = tiles.groupBy("hb", "mb").applyInArrow(lambda t: tile_best(t, k, scale), "query_rid long, query_id long, rid long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_matches(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid, q.vec_id AS query_id, c.rid AS other, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
