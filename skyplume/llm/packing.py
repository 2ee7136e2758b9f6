"""Packing documents into sequences by cutting-stock column generation.

Documents are cut into full sequences and a rest. Rests of up to ``EXACT``
tokens have a class for each length; above, the classes widen with the length,
so that less than one part in ``EXACT // 2`` of a rest is rounded up. The histogram
of the classes is all that the linear program sees, whatever the number of
documents. Columns of the program
are patterns (how many rests of each class share a sequence); a knapsack
dynamic program over the duals prices new ones. The solution's patterns are
rounded down, what is left over is filled greedily, and the patterns are dealt
to the documents by their rank within their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyplume.llm.common import settled, sliced
from skyplume.llm.tokens import encoder

LENGTH = 2048
#: Rests of up to so many tokens are not rounded up.
EXACT = 128
#: Slices of each class's ranks.
SLICES = 512
MAX_COLUMNS = 600
#: Of the optimum, where the linear program stops.
GAP = 2e-4


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items (sizes ascending) that fits ``room``: its value and counts."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    # By size, so that what each item leaves is a slice of the table.
    worth, item = np.full(room + 1, -1.0), np.full(room + 1, -1)
    worth[sizes], item[sizes] = values, np.arange(len(sizes))
    for c in range(1, room + 1):
        gains = best[c - 1 :: -1] + worth[1 : c + 1] if c > 1 else best[:1] + worth[1:2]
        i = int(gains.argmax())
        best[c] = best[c - 1]
        if gains[i] > best[c]:
            best[c], pick[c] = gains[i], item[i + 1]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), counts


def greedy_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """Patterns filled largest class first, each until a class is used up: a feasible basis, triangular in that order."""
    left, basis = demand.astype(float).copy(), np.diag(room // sizes).astype(float)
    while (left > 1e-9).any():
        pattern, space = np.zeros(len(sizes)), room
        for i in np.flatnonzero(left > 1e-9)[::-1]:
            if a := space // sizes[i]:
                pattern[i], space = a, space - a * sizes[i]
        taken = np.flatnonzero(pattern)
        times = left[taken] / pattern[taken]
        left[taken] -= times.min() * pattern[taken]
        done = taken[times.argmin()]
        left[done] = 0
        basis[:, done] = pattern
    return basis


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = MAX_COLUMNS, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used in the relaxed cutting-stock program.

    Revised simplex from the greedy patterns. The best column's value bounds how
    far the solution is from the optimum; it stops within ``gap`` of it, or after
    ``most`` columns, where the solution at hand is feasible as well.
    """
    basis = greedy_basis(sizes, demand, room)
    inverse = np.linalg.inv(basis)
    used = np.maximum(inverse @ demand, 0)
    for step in range(most):
        value, column = knapsack(inverse.sum(axis=0), sizes, room)
        if value <= 1 + gap:
            break
        move = inverse @ column
        ratio = np.full(len(sizes), np.inf)
        np.divide(used, move, out=ratio, where=move > 1e-9)
        out = int(ratio.argmin())
        used = used - ratio[out] * move
        used[out] = ratio[out]
        basis[:, out] = column
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
            used = inverse @ demand
        else:
            row = inverse[out] / move[out]
            inverse = inverse - np.outer(move, row)
            inverse[out] = row
        used = np.maximum(used, 0)
    return basis.astype(np.int64), used


def plan(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: pieces by class, times) that take each class exactly ``counts`` times; patterns at the end may be cut short."""
    left = {c: n for c, n in sorted(counts.items()) if n > 0}
    if not left:
        return []
    sizes, out = np.array(list(left)), []
    patterns, used = column_generation(sizes, np.array(list(left.values()), float), room)
    for k in np.argsort(-used, kind="stable"):
        pattern = {int(c): int(a) for c, a in zip(sizes, patterns[:, k], strict=True) if a}
        times = min([int(used[k] + 1e-6), *(left[c] // a for c, a in pattern.items())])
        if times:
            out.append((pattern, times))
            for c, a in pattern.items():
                left[c] -= a * times
    # The rest, largest first; each pattern uses up a class at least.
    while left := {c: n for c, n in left.items() if n}:
        pattern, space = {}, room
        for c in sorted(left, reverse=True):
            if a := min(left[c], space // c):
                pattern[c], space = a, space - a * c
        times = min(left[c] // a for c, a in pattern.items())
        out.append((pattern, times))
        for c, a in pattern.items():
            left[c] -= a * times
    return out


def runs(plans: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces a sequence, first sequence, first slot): which ranks a pattern takes."""
    taken: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, times in plans:
        slot = 0
        for c, a in sorted(pattern.items(), reverse=True):
            first = taken.get(c, 0)
            out.append((c, first, first + a * times, a, sequence, slot))
            taken[c], slot = first + a * times, slot + a
        sequence += times
    return out


def size_class(size: Column, length: int = LENGTH, exact: int = EXACT) -> Column:
    """The least length of a class that ``size`` fits: steps of 1 up to ``exact``, of 2 up to twice that, of 4 up to four times, and so on."""
    out, step = size, 1
    while exact * step < length:
        out, step = F.when(size > exact * step, F.ceil(size / (2 * step)) * (2 * step)).otherwise(out), 2 * step
    return F.when(size <= length, F.least(out, F.lit(length))).otherwise(size).cast("int")


def planned(counts: pd.DataFrame, length: int) -> pd.DataFrame:
    """``runs`` of the plan for ``counts`` (_class, n)."""
    if counts["_class"].isna().any() or (len(counts) and (counts["_class"].min() < 1 or counts["_class"].max() > length)):
        raise ValueError(f"a piece's length is not within 1 to {length}")
    rows = runs(plan({int(c): int(n) for c, n in zip(counts["_class"], counts["n"], strict=True)}, length))
    return pd.DataFrame(rows, columns=["_c", "_first", "_end", "_a", "_sequence", "_slot"])


def tokenized_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): every document's ids and end id, cut into pieces of up to ``length``.

    ids are little-endian unsigned 32-bit integers. A null text is empty: its
    one piece is the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids = encoder(vocabulary).ids([x or "" for x in b.column("text").to_pylist()])
            rows = [(doc_id, at, x[at : at + length], len(x)) for doc_id, x in zip(b.column("doc_id").to_pylist(), (np.append(x, np.uint32(end_id)).astype("<u4") for x in ids), strict=True) for at in range(0, len(x), length)]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")


def pack(pieces: DataFrame, order: list[str], length: int = LENGTH) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1 to ``length``) and their sequence_id and offset.

    ``order`` are the columns that tell pieces apart; pieces equal in all of them
    may change places. All columns are kept, whatever they are called; those called
    sequence_id or offset are replaced. An empty table gives no rows; a null or
    zero length has no place and is an error.
    """
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    by = [f"_by{k}" for k in range(len(order))]
    rows = pieces.select(F.struct(*kept).alias("_row"), F.col("length").alias("_length"), *[F.col(c).alias(b) for c, b in zip(order, by, strict=True)])
    rows = rows.withColumn("_class", size_class(F.col("_length"), length)).withColumn("_slice", F.pmod(F.xxhash64(*by), F.lit(SLICES)).cast("int"))
    slices = rows.groupBy("_class", "_slice").agg(F.count("*").alias("_n"))
    # One task gets a row for each class, some hundreds whatever the input.
    table = slices.groupBy("_class").agg(F.sum("_n").alias("n")).groupBy().applyInPandas(lambda pdf: planned(pdf, length), "_c int, _first long, _end long, _a long, _sequence long, _slot long")
    table = settled(table)  # also raises errors here
    before = slices.select(F.col("_class").alias("_c2"), F.col("_slice").alias("_s2"), (F.sum("_n").over(W.partitionBy("_class").orderBy("_slice")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_class", "_slice").orderBy(*by)) - 1)
    rows = rows.join(before, (F.col("_class") == F.col("_c2")) & (F.col("_slice") == F.col("_s2"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    rows = rows.join(F.broadcast(table), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    at = F.col("_rank") - F.col("_first")
    rows = rows.withColumns({"_id": F.col("_sequence") + F.floor(at / F.col("_a")).cast("long"), "_place": F.col("_slot") + at % F.col("_a")})
    offset = F.sum("_length").over(W.partitionBy("_id").orderBy("_place")) - F.col("_length")
    return rows.withColumn("_offset", offset).select("_row.*", F.col("_id").alias("sequence_id"), F.col("_offset").alias("offset"))


def sequences(packed: DataFrame, pad_id: int = 0, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids, doc_ids): one row a sequence, ids padded to ``length``; ``packed`` has ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("ids"))))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n"))
    fill = F.repeat(F.lit(f"{pad_id:08x}"), (F.lit(length) - F.col("n")).cast("int"))
    return rows.select("sequence_id", F.unhex(F.concat(F.array_join(F.col("p.ids"), ""), fill)).alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def packed_digest(docs: DataFrame) -> DataFrame:
    """Every piece of ``docs`` with its place and its ids' checksum; tokenized once, and only small rows are shuffled.

    A null text is empty, so its one piece is the end id; very long texts are cut
    into as many pieces as they need. Rows equal in id and text are packed as
    often as they are, a null doc_id stays null; an empty table gives no rows.
    Columns but doc_id and text are not read, whatever they are called.
    """
    pieces = settled(tokenized_pieces(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return pack(pieces, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
