"""How filters of documents interact: what each removes at each step of every order, and its Shapley share.

Each row fails a set of filters. What a coalition of filters removes (the rows
that fail any of them) is tabulated for all coalitions: one row a part, with an
array of 2 ** n counts for all rows, good rows and toxic rows. Everything else
are differences of that table: the filter at a step removes what the coalition
with it removes beyond the coalition of the filters before it.

Shapley shares are the exact solution of a constrained least squares problem:
over all coalitions, weighted by the Shapley kernel, the removals are fitted by
sums of one share a filter, under the constraint that all shares together are
what all filters remove. The normal equations are solved in rationals.

Only small rows are shuffled, never texts: copies meet by the SHA-256 of their
text, the smallest id of each digest is combined before the shuffle, and counts
by part and set of failed filters are all that goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache, reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.llm.common import SPACE, settled

#: Filters by name, in the order of their bits; ``E`` is about other rows and comes with ``failures``.
NAMES = "ABCDE"
MEASURES = ("", "good_", "toxic_")
#: Rows of a text beyond which they are not brought together.
HOT = 1000


def text_failures(text: Column) -> Column:
    """Bits of A to D: few words, few different words, many capitals, odd marks."""
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    n = F.size(words)
    checks = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text), F.regexp_like(text, F.lit("[#$%&*|]")))
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks)])


def failures(docs: DataFrame, labels: DataFrame, hot: int = HOT) -> DataFrame:
    """(part, mask, good, toxic) of every row of ``docs`` (doc_id, text, lang): the filters it fails as bits, and its labels.

    A null text is empty, a null lang is the part ''. E fails where the same text
    has a smaller doc_id, in whatever part; a row without doc_id never does, nor
    does it make others fail; repeated rows of the smallest doc_id all pass. Where
    ``labels`` (doc_id, quality, toxic) has several rows for a doc_id, any that is 1 counts. Texts
    of any length are read whole; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("mask"))
    first = settled(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1"))
    # Texts with very many rows are known everywhere, and their rows go on without meeting; by their size there are 50,000 at most.
    limit = max(hot, (first.agg(F.sum("n")).first()[0] or 0) // 50_000)
    many = F.broadcast(first.filter(F.col("n") > limit).select(F.col("digest").alias("_h"), F.col("first_id").alias("_hot_id")))
    rows = rows.join(many, F.col("digest") == F.col("_h"), "left")
    rows = rows.withColumn("digest", F.when(F.col("_h").isNull(), F.col("digest")).otherwise(F.monotonically_increasing_id().cast("string").cast("binary")))
    few = first.filter(F.col("n") <= limit).select(F.col("digest").alias("_d"), "first_id")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_l")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Both joins keep all rows of the left side, so that Spark can split a repeated id.
    rows = rows.join(few, F.col("digest") == F.col("_d"), "left").withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.coalesce("_hot_id", "first_id"), 16).otherwise(0))
    rows = rows.select("doc_id", "part", "mask").join(marks, F.col("doc_id") == F.col("_l"), "left")
    return rows.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def coalition_table(failed: DataFrame, n: int) -> DataFrame:
    """One row for each part of ``failed`` (part, mask, good, toxic): ``total`` and, by coalition, the rows that it removes (removed, good_removed, toxic_removed)."""
    cells = failed.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("rows"))
    hit = [F.col("mask").bitwiseAND(s) != 0 for s in range(1 << n)]
    weight = {"": F.col("rows"), "good_": F.col("rows") * F.col("good"), "toxic_": F.col("rows") * F.col("toxic")}
    sums = [F.array(*[F.sum(F.when(h, weight[m]).otherwise(0)) for h in hit]).alias(f"{m}removed") for m in MEASURES]
    return cells.groupBy("part").agg(F.sum("rows").alias("total"), *sums)


@cache
def kernel(n: int) -> tuple[Fraction, ...]:
    """The Shapley kernel's weight of each coalition; none for the empty and the whole one, which are fitted exactly."""
    size = [s.bit_count() for s in range(1 << n)]
    return tuple(Fraction(n - 1, math.comb(n, k) * k * (n - k)) if 0 < k < n else Fraction(0) for k in size)


def solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system, by elimination."""
    rows = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(k for k in range(i, len(rows)) if rows[k][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(len(rows)):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [row[-1] for row in rows]


def shapley_shares(value: list[int], n: int) -> list[Fraction]:
    """Each player's share of ``value`` (by coalition; the empty one has 0), from the normal equations with the multiplier of the constraint."""
    w = kernel(n)
    has = lambda s, i: s >> i & 1
    normal = [[sum((w[s] for s in range(1 << n) if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] for i in range(n)]
    right = [sum((w[s] * value[s] for s in range(1 << n) if has(s, i)), Fraction(0)) for i in range(n)]
    bordered = [[*row, Fraction(1)] for row in normal] + [[Fraction(1)] * n + [Fraction(0)]]
    return solved(bordered, [*right, Fraction(value[-1])])[:n]


STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audited(row: dict, names: str) -> Iterator[tuple]:
    """The steps of all orders for a row of ``coalition_table``."""
    n, v, good, toxic = len(names), row["removed"], row["good_removed"], row["toxic_removed"]
    everyone, orders = (1 << n) - 1, math.factorial(n)
    shares = [int(orders * x) for x in shapley_shares(v, n)]  # whole numbers: sums over orders
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = v[after] - v[before]
            yield row["part"], "".join(names[i] for i in order), step, row["total"] - v[after], gone, v[1 << f] - gone, v[everyone] - v[everyone ^ 1 << f], good[after] - good[before], toxic[after] - toxic[before], shares[f]
            before = after


def filter_audit(failed: DataFrame, names: str = NAMES) -> DataFrame:
    """The steps of all orders of the filters ``names`` (bits of ``mask``, a letter each) for each part of ``failed`` (part, mask, good, toxic).

    Counts are of rows within the part: kept after the step, removed by it,
    redundant (fail its filter, but removed before), unique_fails (fail its filter
    only), good_lost and toxic_lost among the removed, and shapley, the filter's
    removals summed over all orders. Steps that remove nothing are there with zeros;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                steps = list(zip(*audited(row, names), strict=True))
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(steps, kinds, strict=True)], [x.split()[0] for x in STEPS.split(", ")])

    return coalition_table(failed, len(names)).mapInArrow(run, STEPS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return filter_audit(failures(docs, labels))


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id > m.first_id THEN 'E' ELSE '' END AS fails
  FROM t JOIN m ON t.text = m.text LEFT JOIN l ON t.doc_id = l.doc_id),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substring(filter_order, CAST(k AS INTEGER), 1) AS x, substring(filter_order, 1, CAST(k AS INTEGER) - 1) AS before FROM o, range(1, 6) r(k)),
j AS (
  SELECT c.*, s.*, contains(fails, s.x) AS own, before <> '' AND fails <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone
  FROM c, s),
g AS (
  SELECT part, filter_order, step, x,
    coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(n) FILTER (own AND NOT gone AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (own AND NOT gone AND toxic = 1), 0) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM g
"""
