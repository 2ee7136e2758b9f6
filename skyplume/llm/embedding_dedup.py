"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits the unit vectors of each label node by node: every node has its
own random direction and splits at the median projection of its own vectors, as
long as it holds more than ``LEAF``. A vector whose projection lies within the
spill of a split goes to both sides: it lives in one home leaf and visits the
leaves that its spills reach. Home vectors of a leaf are compared with all in
the leaf, by exact cosine in double precision.

Trees grow ``LEVELS`` levels at a time: medians are fitted on a bounded sample
of each node's vectors (some ``SAMPLE``, by hash), and all vectors are routed.
A node that its directions can't part (half of it would spill) stays a leaf; a
large leaf is compared in tiles. Projections of unit vectors shrink with the
root of the dimension, and so does the spill. The number of trees follows from
the depth, so that the share of pairs at the threshold that no tree shows stays
within ``MISS`` whatever the size; the test measures recall against brute force.

Only ids and nodes are kept between rounds; vectors are joined where they are
compared. Equal vectors are one row with a count. A pair that several trees or
leaves show is counted in the first that shows it, which both ends can tell from
their leaves; so counts are summed without listing the pairs, and each tile of a
leaf hands on counts and a star per connected group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.llm.common import components, min_labels, numbered, settled, tiled

COSINE = 0.98
#: Half-width of a split's spill, times the root of the dimension: some 6 % of a node's vectors go to both sides.
SPILL = 0.07
#: Of pairs of cosine ``COSINE``, the share that a split parts beyond its spill (calculated for directions in all dimensions alike).
PARTED = 0.04
#: Of those pairs, the share that may meet in no tree.
MISS = 5e-4
#: Vectors of a node that its splits are fitted on, about; all vectors are indexed.
SAMPLE = 2048
#: Levels that are fitted together.
LEVELS = 6
TILE = 2048
#: Vectors at home in a leaf, at most, where they can be parted.
LEAF = 200


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), embedding (doubles), ``usable``: labelled, not null, not zero, all components finite."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), x.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tree_count(largest: int, leaf: int = LEAF, miss: float = MISS) -> int:
    """Trees for labels of up to ``largest`` vectors."""
    depth = max(0, math.ceil(math.log2(max(1, largest) / leaf)))
    kept = (1 - PARTED) ** depth
    return 1 if depth == 0 else max(2, math.ceil(math.log(miss) / math.log(1 - kept)))


def direction(dim: int, tree: int, node: int) -> np.ndarray:
    """A node's unit vector, the same at every call."""
    d = np.random.default_rng((dim, tree, node)).normal(size=dim)
    return d / np.sqrt((d * d).sum())


def fit_node(x: np.ndarray, n: int, tree: int, node: int, spill: float, leaf: int, levels: int = LEVELS) -> np.ndarray:
    """Medians of the splits below ``node``, by their place in a heap; NaN where a leaf is. ``x`` is a sample of the node's ``n`` vectors."""
    out = np.full(1 << levels, np.nan)
    held = {1: np.arange(len(x))}
    for k in range(1, 1 << levels):
        rows = held.pop(k, None)
        if rows is None or n * len(rows) / len(x) <= leaf or len(rows) < 2:
            continue
        depth = k.bit_length() - 1
        p = x[rows] @ direction(x.shape[1], tree, (node << depth) + k - (1 << depth))
        at = float(np.median(p))
        if (np.abs(p - at) < spill).mean() > 0.5:
            continue
        out[k] = at
        held[2 * k], held[2 * k + 1] = rows[p <= at], rows[p > at]
    return out


def route(x: np.ndarray, own: np.ndarray, splits: np.ndarray, tree: int, node: int, spill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, own, settled) of all places below ``node`` that vectors at it reach; settled: a leaf, else the levels were used up."""
    levels = len(splits).bit_length() - 1
    held, out = {1: (np.arange(len(x)), own)}, []
    for k in range(1, 2 << levels):
        if k not in held:
            continue
        rows, mine = held.pop(k)
        depth = k.bit_length() - 1
        here = (node << depth) + k - (1 << depth)
        if depth == levels or np.isnan(splits[k]):
            out.append((rows, np.full(len(rows), here), mine, np.full(len(rows), depth < levels)))
            continue
        gap = x[rows] @ direction(x.shape[1], tree, here) - splits[k]
        for side, home in ((0, gap <= 0), (1, gap > 0)):
            go = home | (np.abs(gap) < spill)
            if go.any():
                held[2 * k + side] = (rows[go], (mine & home)[go])
    return tuple(np.concatenate([o[i] for o in out]) for i in range(4))


KEYS = ["label", "dim", "tree", "node"]


def forest(units_: DataFrame, trees: int, spill: float, leaf: int, rounds: int = 10) -> DataFrame:
    """(vec_id, label, dim, tree, node, own): the leaves that the vectors of ``units_`` (vec_id, label, dim, unit) live in and visit."""
    live = units_.select("vec_id", "label", "dim", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(True).alias("own"))
    leaves = None
    held = "label string, dim int, tree int, node long, "

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        splits = fit_node(x, int(first["n"]), int(first["tree"]), int(first["node"]), spill / math.sqrt(x.shape[1]), leaf)
        return pd.DataFrame({**{c: [first[c]] for c in KEYS}, "splits": [splits.tobytes()]})

    def move(batches):
        for pdf in batches:
            for (label, dim, tree, node), part in pdf.groupby(KEYS, sort=False):
                x = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
                splits = np.frombuffer(part["splits"].iloc[0])
                at, to, own, done = route(x, part["own"].to_numpy(), splits, int(tree), int(node), spill / math.sqrt(x.shape[1]))
                yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[at], "label": label, "dim": dim, "tree": tree, "node": to, "own": own, "done": done})

    for _ in range(rounds):
        sizes = live.groupBy(*KEYS).agg(F.count_if("own").alias("n"))
        live = settled(live.join(sizes, KEYS))
        small = live.filter(F.col("n") <= leaf).drop("n")
        leaves = small if leaves is None else leaves.union(small)
        large = live.filter(F.col("n") > leaf)
        if large.isEmpty():
            return leaves
        picked = F.pmod(F.xxhash64("vec_id", "tree"), F.lit(1 << 20)) * F.col("n") < SAMPLE << 20
        sample = large.filter(F.col("own") & picked).join(units_.select("vec_id", "unit"), "vec_id")
        splits = settled(sample.groupBy(*KEYS).applyInPandas(fit, held + "splits binary"))
        placed = large.join(units_.select("vec_id", "unit"), "vec_id").join(splits, KEYS)
        moved = settled(placed.select("vec_id", *KEYS, "own", "unit", "splits").mapInPandas(move, f"vec_id long, {held}own boolean, done boolean"))
        leaves = leaves.union(moved.filter("done").drop("done").select(leaves.columns))
        live = moved.filter("not done").drop("done").select(leaves.columns)
    return leaves.union(live)  # nodes that no number of splits has parted


def paths(leaves: DataFrame, trees: int) -> DataFrame:
    """(vec_id, home, at_tree, at_leaf): each vector's home leaf by tree, and all its leaves."""
    every = leaves.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("tree", "node", "own"))).alias("p"))
    return every.select("vec_id", F.filter("p", lambda x: x["own"])["node"].alias("home"), F.col("p.tree").alias("at_tree"), F.col("p.node").alias("at_leaf"))


def visited(pdf: pd.DataFrame, trees: int) -> np.ndarray:
    """(rows, trees, most): leaves of each row by tree, 0 beyond them."""
    count = pdf["at_tree"].map(len).to_numpy()
    row = np.repeat(np.arange(len(pdf)), count)
    tree, leaf = np.concatenate(pdf["at_tree"].to_numpy()), np.concatenate(pdf["at_leaf"].to_numpy())
    code = row * trees + tree  # ascending
    first = np.searchsorted(code, code)
    out = np.zeros((len(pdf) * trees, int((np.arange(len(code)) - first).max()) + 1), np.int64)
    out[code, np.arange(len(code)) - first] = leaf
    return out.reshape(len(pdf), trees, -1)


def tile_links(pdf: pd.DataFrame, cosine: float, trees: int) -> pd.DataFrame:
    """Rows (kind, a, b): kind 0, ``b`` more links of each copy of vector a; kind 1, a and b are joined."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    t, leaf = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
    x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
    home, reach = np.stack(pdf["home"].to_numpy()), visited(pdf, trees)
    node, n, own, role = (pdf[c].to_numpy() for c in ("vec_id", "n", "own", "role"))
    left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    extra = np.zeros(len(pdf), np.int64)
    nodes, place = np.unique(node, return_inverse=True)
    label = np.arange(len(nodes))
    step = max(1, (1 << 19) // max(1, len(right)))
    for k in range(0, len(left), step):
        i, j = np.nonzero(x[left[k : k + step]] @ x[right].T >= cosine)
        i, j = left[i + k], right[j]
        # Two home vectors meet in both orders; a vector meets itself.
        ok = np.where(own[j], node[i] < node[j], True)
        i, j = i[ok], j[ok]
        # A visitor's own home leaf may show the pair too; the smaller leaf counts it.
        ok = own[j] | (home[j, t] > leaf) | ~(reach[i, t] == home[j, t, None]).any(axis=1)
        i, j = i[ok], j[ok]
        for e in range(t):  # a tree before this one
            if not len(i):
                break
            new = ~((reach[j, e] == home[i, e, None]).any(axis=1) | (reach[i, e] == home[j, e, None]).any(axis=1))
            i, j = i[new], j[new]
        np.add.at(extra, i, n[j])
        np.add.at(extra, j, n[i])
        a, b = label[place[i]], label[place[j]]
        if (a != b).any():
            label = min_labels(len(nodes), a, b)[label]
    some = np.flatnonzero(extra)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pd.DataFrame({"kind": np.repeat([0, 1], [len(some), len(moved)]), "a": np.concatenate((node[some], nodes[moved])), "b": np.concatenate((extra[some], nodes[label[moved]]))})


def unit_rows(classes: DataFrame) -> DataFrame:
    """(vec_id, label, dim, n, unit) of ``classes``: unit vectors as bytes."""

    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                x = units(np.stack(part["embedding"].to_numpy()))
                yield part.drop(columns=["embedding"]).assign(dim=dim, unit=[row.tobytes() for row in x])[["vec_id", "label", "dim", "n", "unit"]]

    return classes.select("vec_id", "label", "n", "embedding").mapInPandas(run, "vec_id long, label string, dim int, n long, unit binary")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int | None = None, spill: float = SPILL, leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine is
    ``cosine`` or more; those of different lengths don't, nor do vectors that are
    null, empty or zero or hold a null or non-finite component: they have no
    links and are their own component. n_links counts other rows, copies
    included; rows repeated with the same vec_id count each other as copies do.
    Vectors of any length are compared with those of their length. An empty table
    gives no rows. Labels may be of any type that has a text. Other columns are not
    read, whatever they are called.
    """
    rows = settled(clean(vectors))
    good = rows.filter("usable").withColumn("key", F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    keyed = settled(good.select("vec_id", "label", "embedding", "key"))
    classes = keyed.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    # A vec_id with several vectors names the first of them here; each class has a number of its own.
    classes = numbered(classes, "key", "number")
    vecs = settled(unit_rows(classes.select(F.col("number").alias("vec_id"), "label", "n", "embedding")))
    largest = vecs.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    trees = trees or tree_count(largest, leaf)
    leaves = settled(forest(vecs, trees, spill, leaf))
    spread = leaves.join(vecs.select("vec_id", "n", "unit"), "vec_id").join(paths(leaves, trees), "vec_id")
    found = settled(tiled(spread, KEYS, "own", "vec_id", tile).groupBy(*KEYS, "hb", "mb").applyInPandas(lambda pdf: tile_links(pdf, cosine, trees), "kind int, a long, b long"))
    extra = found.filter("kind = 0").groupBy(F.col("a").alias("_x")).agg(F.sum("b").alias("extra"))
    comps = settled(components(found.filter("kind = 1").select("a", "b")))
    by_class = classes.select("key", "number", "vec_id", "n").join(extra, F.col("number") == F.col("_x"), "left").join(comps, F.col("number") == F.col("node"), "left")
    by_class = by_class.select("key", "vec_id", (F.col("n") - 1 + F.coalesce("extra", F.lit(0))).alias("n_links"), F.coalesce("component", "number").alias("root"))
    least = by_class.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    by_class = by_class.join(least, "root").select(F.col("key").alias("_key"), "n_links", "component_id")
    linked = keyed.select("vec_id", "key").join(by_class, F.col("key") == F.col("_key")).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
