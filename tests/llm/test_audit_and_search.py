"""Filter audit, hard negatives and exact search against brute force, on odd rows too."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyplume.llm import filter_audit, hard_negatives, topk_search, vectors

LABELS = "doc_id long, quality int, toxic int"

# 11


def failed(rows):
    """Letters that each of ``rows`` (doc_id, text) fails, in plain Python."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
        others = [i for i, t in rows if (t or "") == text and i is not None]
        checks = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), doc_id is not None and min(others) < doc_id)
        out.append("".join(x for x, c in zip("ABCDE", checks, strict=True) if c))
    return out


def walked(rows, labels):
    """The audit by applying the filters of each order in turn."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails, out = failed([r[:2] for r in rows]), {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                share[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def audited(docs, labels):
    rows = filter_audit.filter_audit(filter_audit.failures(docs, labels)).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_audit_on_odd_rows(spark, odd, none):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randint(0, 999)}" for _ in range(260))
    more = [(5000 + i, f"{long} {m}", lang) for i, (m, lang) in enumerate([("", "en"), ("", "de"), ("$", "en"), ("A" * 60, None), ("#" + "B" * 99, ""), ("", "en")])] + [(7000, "same " * 300, "en"), (7001, "same " * 300, "fr"), (7000, "same " * 300, "en"), (None, "same " * 300, "fr")]
    docs = odd.select("doc_id", "text", "lang", F.lit("x").alias("mask"), F.lit("x").alias("part"), F.lit("x").alias("digest")).union(spark.createDataFrame([(*r, "x", "x", "x") for r in more], "doc_id long, text string, lang string, mask string, part string, digest string"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, *_ in rows if i is not None and rng.random() < 0.7] + [(7000, 1, 0), (7000, 0, 1), (None, 1, 1)]
    marks = [*dict.fromkeys(marks)]
    want = walked(rows, marks)
    assert audited(docs, spark.createDataFrame(marks, LABELS)) == want
    few = filter_audit.filter_audit(filter_audit.failures(docs, spark.createDataFrame(marks, LABELS), hot=2))  # texts with three rows or more go apart
    assert sorted(tuple(r) for r in few.collect()) == sorted((*k, *v) for k, v in want.items())
    assert audited(none, spark.createDataFrame([], LABELS)) == {}


def test_audit_without_labels(spark, odd):
    got = audited(odd, spark.createDataFrame([], LABELS))
    assert got == walked([(r.doc_id, r.text, r.lang) for r in odd.collect()], [])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shares_of_least_squares_are_means_over_orders(n):
    rng = random.Random(n)
    for _ in range(5):
        value = [0, *(rng.randint(-50, 99) for _ in range((1 << n) - 1))]
        want = [Fraction(0)] * n
        for order in permutations(range(n)):
            before = 0
            for i in order:
                want[i] += Fraction(value[before | 1 << i] - value[before], math.factorial(n))
                before |= 1 << i
        assert filter_audit.shapley_shares(value, n) == want


# 12 and 13

VECTORS = "vec_id long, embedding array<double>, label int, rid string, hb string, mb string, role string, score string, every string"


def odd_vectors(n=260, dims=19):
    """Ties, repeats, nulls, odd lengths, sparse and large rows, a hot label, and columns whose names clash."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        x = rng.normal(size=dims).round(2)
        if i % 3 == 0:
            x[rng.random(dims) < 0.8] = 0
        rows.append((i, x.tolist(), int(rng.integers(0, 4)) if i % 3 else 1))
    rows += [(20, rows[20][1], rows[20][2]), (100, rows[100][1], rows[100][2]), (7, rows[40][1], 2), (400, rows[40][1], 1), (1000, rows[0][1], 0), (None, rows[60][1], 3), (None, rows[61][1], 1)]
    rows += [(800, None, 1), (820, [1.0, None], 1), (840, [float("nan")] * dims, 1), (860, [1.0, float("inf")], 0), (880, [], 1), (900, [0.0] * dims, 1), (920, [3.0, -2.0], 2), (940, [1.5] * (dims + 4), 1), (600, rows[5][1], None), (500, [4000.25, -3000.0], 1), (960, [-1e-9, 1e-320], 1)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in rows], VECTORS)


def whole(rows, scale, labelled=False):
    out = []
    for i, x, label in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x) and (label is not None or not labelled):
            out.append((i, [math.floor(scale * v) for v in x], label))
    return out


def product(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def in_order(pairs):
    """(vec_id, score) by falling score, ties by id, none last."""
    return sorted(pairs, key=lambda p: (-p[1], p[0] is None, p[0] or 0))


@pytest.mark.parametrize("tile", [None, 64])
def test_search(spark, tile):
    rows = whole(odd_vectors(), 64)
    want = []
    for k, (q, x, _) in enumerate(rows):
        if q is not None and q % 20 == 0:
            best = in_order([(i, product(x, y)) for j, (i, y, _) in enumerate(rows) if j != k])[:20]
            want += [(q, rank, i, s) for rank, (i, s) in enumerate(best, 1)]
    got = topk_search.best_matches(table(spark, odd_vectors()), F.col("vec_id") % 20 == 0, tile=tile).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_search_in_small_tables(spark):
    is_query = F.col("vec_id") % 20 == 0
    assert topk_search.best_matches(table(spark, []), is_query).count() == 0
    assert topk_search.best_matches(table(spark, [(20, [1.0], 0)]), is_query).count() == 0
    assert topk_search.best_matches(table(spark, [(1, [1.0], 0), (2, [1.0], 0)]), is_query).count() == 0
    got = topk_search.best_matches(table(spark, [(20, [1.0], 0), (3, [-1.0], 0), (2, [-1.0], None)]), is_query).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 2, -4096), (20, 2, 3, -4096)]


def test_accumulation_scatters_and_adds():
    rng = np.random.default_rng(1)
    members = rng.integers(-9, 9, (50, 12)) * (rng.random((50, 12)) < np.linspace(0, 1, 12))
    lists = topk_search.postings(members)
    assert {rows is None for rows, _ in lists} == {True, False}
    for query in rng.integers(-9, 9, (20, 12)) * (rng.random((20, 12)) < 0.5):
        out = np.zeros(50, members.dtype)
        topk_search.accumulate(query, lists, out, np.empty(50, members.dtype))
        assert (out == members @ query).all()


def test_selection_keeps_ties_in_order():
    scores = np.random.default_rng(2).integers(-3, 4, (30, 40)).astype(np.int16)
    row, column = topk_search.best_of(scores, 7)
    for i in range(30):
        assert column[row == i].tolist() == sorted(range(40), key=lambda j: (-int(scores[i, j]), j))[:7]


def test_scores_are_lookups():
    rng = np.random.default_rng(3)
    for dims, most in ((1, 1), (8, 3), (9, 300), (64, 256), (70, 1 << 27)):
        a, b = rng.integers(-most, most, (37, dims)), rng.integers(-most, most, (1500, dims))
        b[0], b[1] = -most, most
        got = np.concatenate([x for _, x in hard_negatives.scores(a, b)])
        assert (got == a @ b.T).all()
    assert hard_negatives.bit_planes(np.zeros((3, 0), int)).shape[2] == 3


def test_types_hold_all_sums():
    ones = np.ones((1, 64), np.int64)
    assert vectors.score_type(ones, ones) is np.int16 and vectors.score_type(ones * 300, ones * 300) is np.int32 and vectors.score_type(ones << 20, ones << 20) is np.int64
    with pytest.raises(OverflowError):
        vectors.score_type(ones << 30, ones << 30)


def mined(rows):
    rows = whole(rows, 256, True)
    out = []
    for k, (a, x, label) in enumerate(rows):
        if a is None or a % 100:
            continue
        scored = [(i, product(x, y), lab) for j, (i, y, lab) in enumerate(rows) if j != k]
        for p, ps in in_order([(i, s) for i, s, lab in scored if lab == label])[:5]:
            near = [(i, s) for i, s, lab in scored if lab != label and 30 * ps <= 100 * s <= 90 * ps]
            out += [(a, p, rank, i, ps, s) for rank, (i, s) in enumerate(in_order(near)[:10], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("tile", [None, 64])
def test_hard_negatives(spark, tile):
    rows = odd_vectors()
    got = hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, tile=tile).collect()
    assert sorted(map(str, map(tuple, got))) == mined(rows)
    assert len(got) > 100


def test_hard_negatives_in_small_tables(spark):
    run = lambda rows: [tuple(r) for r in hard_negatives.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0).collect()]
    assert run([]) == [] and run([(100, [1.0], 1)]) == [] and run([(100, [1.0], 1), (1, [0.5], 2)]) == []
    # A positive score of 0 or less: only a negative of 0 is within its bounds, none of a negative one.
    assert run([(100, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 5.0], 2), (3, [0.5, 0.0], 2)]) == [(100, 1, 1, 2, 0, 0)]
    assert run([(100, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2)]) == []
