"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: the 64 bits are cut into blocks and
each block is covered by the repetition code (all zeros, all ones), so an
anchor has one bit per block, the block's majority. A fingerprint belongs to
its nearest anchor. Whatever lies within ``DISTANCE`` bits of a fingerprint of
anchor A is itself at most that many flipped bits away from belonging to A, so
a fingerprint is replicated to every anchor that such flips reach: the covering
radius plus the threshold, taken block by block. Comparing each anchor's own
fingerprints with all that are replicated to it therefore loses no link.

A similarity of 0.8 differs in some 15 % of the bits, beyond what one code can
cover without replicating everything. ``similar_documents`` takes several
independent codes over a wider fingerprint instead: one-bit blocks, radius 0.
The bits of a code grow with the table, and the codes with the bits, so that
the chance to miss a pair at the threshold stays within ``MISS`` whatever the
table's size (less for closer pairs). Fingerprints only propose: what they join
is a rough group, in which pairs are linked where their sets of shingles have
the similarity exactly.

Only distinct fingerprints are replicated and compared, so a group of copies is
one row; an anchor with many distinct fingerprints is cut into tiles; and each
task hands on a star per connected group, not its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.llm.common import components, min_labels, numbered, settled, sliced, tiled

DISTANCE = 2
#: Fingerprints in a tile's block.
TILE = 4096
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16
SEED = 42


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of whole UTF-8 text, some at a time; no words: none."""
    words = text.lower().split()  # A-Z only; splits at \\x20 and \\x09-\\x0D
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    for at in range(0, n, CHUNK):
        part = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.fromiter((digest(line[a:b], SEED) for a, b in part), np.uint64, min(CHUNK, n - at))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The different hashes of the text's shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def majority_bits(hashes: Iterable[np.ndarray], wide: int) -> np.ndarray:
    """``wide`` words of the bits that most hashes have; word 0 counts the hashes as they are, the further words remixed ones."""
    n, ones = 0, np.zeros((wide, 64), np.int64)
    for h in hashes:
        n += len(h)
        for k in range(wide):
            if k:
                h = h * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: bytes, width: int = 3, wide: int = 1) -> np.ndarray:
    """Fingerprint of whole UTF-8 text: ``wide`` words of 64 bits; no words: 0."""
    return majority_bits(shingle_hashes(text, width), wide)


def set_fingerprint(text: bytes, width: int, wide: int = 1) -> np.ndarray:
    """As ``fingerprint``, each shingle counted once however often it comes."""
    h = shingle_set(text, width)
    return majority_bits((h[at : at + CHUNK] for at in range(0, len(h), CHUNK)), wide)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [fingerprint(x.as_py() or b"", width).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(b"".join(raw), np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int) -> list[int]:
    """The bits of each block as a signed 64-bit mask; every bit is in one block."""
    masks = [sum(1 << b for b in range(64) if b * blocks // 64 == k) for k in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_count(n: int) -> int:
    """Blocks for ``n`` distinct fingerprints: some hundred at each anchor. Any number gives the same links."""
    return min(32, max(4, round(math.log2(n + 2)) - 6))


def anchors(fp: Column, blocks: int, distance: int = DISTANCE) -> tuple[Column, Column]:
    """The nearest anchor, and the array of all other anchors that ``distance`` flips reach."""
    home, costs = F.lit(0).cast("long"), []
    for k, mask in enumerate(block_masks(blocks)):
        size = bin(mask & (2**64 - 1)).count("1")
        t = size // 2 if size > 1 else 1
        t = max(t, 1)
        c = F.bit_count(fp.bitwiseAND(F.lit(mask)))
        on = c >= t
        home = home + F.when(on, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        costs.append(F.struct(F.lit(1 << k).cast("long").alias("bit"), F.when(on, c - t + 1).otherwise(t - c).alias("cost")))
    near = F.filter(F.array(*costs), lambda x: x["cost"] <= distance)
    # All sets of blocks whose costs add up to `distance` at most, grown block by block.
    none = F.array(F.struct(F.lit(0).cast("long").alias("bits"), F.lit(0).alias("spent")))
    grow = lambda acc, x: F.concat(acc, F.filter(F.transform(acc, lambda s: F.struct((s["bits"] + x["bit"]).alias("bits"), (s["spent"] + x["cost"]).cast("int").alias("spent"))), lambda s: s["spent"] <= distance))
    sets = F.aggregate(near, none, grow)
    return home, F.filter(F.transform(sets, lambda s: s["bits"].bitwiseXOR(home)), lambda a: a != home)


def segments(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of equal values in the sorted ``code``."""
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return first, np.diff(np.append(first, len(code)))


def close_pairs(code: np.ndarray, fp: np.ndarray, role: np.ndarray, distance: int, short: int = 96) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i, j of one tile (``code``, sorted), a home row and a member, whose fingerprints differ in ``distance`` bits or fewer."""
    differ = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]).sum(axis=-1, dtype=np.int32)
    first, size = segments(code)
    small = np.repeat(size <= short, size)
    rows = np.flatnonzero(small)
    for shift in range(1, int(size[size <= short].max(initial=1))):
        i, j = rows[:-shift], rows[shift:]
        ok = (code[i] == code[j]) & (((role[i] & 1) & (role[j] >> 1)) | ((role[j] & 1) & (role[i] >> 1)) > 0)
        i, j = i[ok], j[ok]
        near = differ(i, j) <= distance
        yield i[near], j[near]
    for at, n in zip(first[size > short].tolist(), size[size > short].tolist(), strict=True):
        own = at + np.flatnonzero(role[at : at + n] & 1)
        all_ = at + np.flatnonzero(role[at : at + n] & 2)
        step = max(1, (1 << 21) // max(1, len(all_)) // fp.shape[1])
        for k in range(0, len(own), step):
            i, j = np.nonzero(differ(own[k : k + step, None], all_[None, :]) <= distance)
            yield own[i + k], all_[j]


def stars(node: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what the pairs of rows join; at most one for each node."""
    nodes, place = np.unique(node, return_inverse=True)
    label = np.arange(len(nodes))
    for i, j in pairs:
        i, j = label[place[i]], label[place[j]]
        open_ = i != j
        if open_.any():
            label = min_labels(len(nodes), i[open_], j[open_])[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def star_links(rows: DataFrame, distance: int, tile: int, per_task: int = 100_000) -> DataFrame:
    """Edges (a, b) over ``rows`` (node, fp binary, anchor, own): what close pairs of an anchor join.

    Whole anchors are dealt to tasks by hash, some at a time; a hot anchor comes
    in tiles, dealt likewise.
    """
    bins = max(1, rows.count() // per_task)
    dealt = tiled(rows, ["anchor"], "own", "node", tile).withColumn("bin", F.pmod(F.xxhash64("anchor", "hb", "mb"), F.lit(bins)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pd.util.hash_pandas_object(pdf[["anchor", "hb", "mb"]], index=False).to_numpy()
        order = np.argsort(code, kind="stable")
        fp = np.frombuffer(b"".join(pdf["fp"].to_numpy()[order]), np.uint64).reshape(len(pdf), -1)
        node, role = pdf["node"].to_numpy()[order], pdf["role"].to_numpy()[order]
        a, b = stars(node, close_pairs(code[order], fp, role, distance))
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("bin").applyInPandas(run, "a long, b long")


def dealt_out(rows: DataFrame, n: int, per_task: int = 10_000) -> DataFrame:
    """``rows`` in tasks of about ``per_task``, for each becomes many."""
    return rows.repartition(n // per_task + 1, rows.columns[0])


def links(fps: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Edges (a, b) over distinct 64-bit fingerprints ``fps`` (fp) that join what close pairs join."""
    n = fps.count()
    blocks = block_count(n)
    home, others = anchors(F.col("fp"), blocks, distance)
    each = F.concat(F.array(F.struct(home.alias("anchor"), F.lit(True).alias("own"))), F.transform(others, lambda a: F.struct(a.alias("anchor"), F.lit(False).alias("own"))))
    raw = F.unhex(F.lpad(F.hex("fp"), 16, "0"))  # counting bits works in either byte order
    rows = dealt_out(fps, n).select("fp", raw.alias("raw"), F.explode(each).alias("x"))
    return star_links(rows.select(F.col("fp").alias("node"), F.col("raw").alias("fp"), "x.anchor", "x.own"), distance, tile)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = 3, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    component_id is the smallest doc_id reachable by links, the document's own
    included. Null, empty and blank texts have fingerprint 0 and link with each
    other and with whatever lies near 0. Repeated rows come back as often as
    they are; a null doc_id is never a component's id unless all are null. Texts
    of any length are read whole. An empty table gives no rows. Other columns are
    not read.
    """
    prints = settled(fingerprints(docs, width))
    firsts = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comps = settled(components(links(firsts.select("fp"), distance, tile)))
    grouped = firsts.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = grouped.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(by_fp, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


#: For ``similar_documents``: words, and the most bits that compared pairs may differ in (pairs of similarity 0.8: 38.8 on average, one in 1,000 more than 56).
WIDE, WIDE_DISTANCE = 4, 56
#: The similarity, as a fraction.
ALIKE = (4, 5)
#: Documents in a block of a large rough group, and bytes of shingles for a task.
BLOCK, TASK_BYTES = 512, 16 << 20
#: Of pairs of similarity 0.8, the share that may meet at no anchor.
MISS = 0.02


def code_bits(n: int) -> int:
    """Bits of a code for ``n`` distinct fingerprints: some dozens at each anchor."""
    return min(40, max(6, round(math.log2(n + 2)) - 6))


def code_count(bits: int, width: int = 64 * WIDE, miss: float = MISS) -> int:
    """Codes of ``bits`` of ``width`` bits with which pairs of similarity 0.8 share no anchor in ``miss`` of the cases.

    Two sets of that similarity are at a cosine of 8/9 at least; each bit
    differs with the share of that angle.
    """
    p = math.acos(8 / 9) / math.pi
    weight = np.array([math.comb(width, d) * p**d * (1 - p) ** (width - d) for d in range(width + 1)])
    apart = 1 - np.array([math.comb(width - d, bits) / math.comb(width, bits) for d in range(width + 1)])
    none, codes = weight * apart, 1
    while none.sum() > miss:
        none, codes = none * apart, codes + 1
    return codes


def code_places(bits: int, codes: int, width: int = 64 * WIDE) -> list[np.ndarray]:
    """The bits that each code reads."""
    return [np.random.default_rng(k).choice(width, bits, replace=False) for k in range(codes)]


def code_anchors(fp: np.ndarray, places: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each code the anchors of ``fp`` (rows of words); anchors of different codes differ."""
    on = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little").astype(np.int64)
    for k, at in enumerate(places):
        yield on[:, at] @ (1 << np.arange(len(at), dtype=np.int64)) * len(places) + k


def text_bytes(text: Column) -> Column:
    """UTF-8 of the text, none if null."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def document_key(doc_id: Column, raw: Column) -> Column:
    """Digest of doc_id and text together: rows of one key are equal in both."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")).cast("binary"), F.lit(b" "), raw), 256))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the text as bytes."""
    raw = text_bytes(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), document_key(F.col("doc_id"), raw).alias("key"), raw.alias("text"))


def wide_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, fp) of every row of ``docs``: the wide fingerprint of the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps = [set_fingerprint(x.as_py(), width, WIDE).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary())], ["doc_id", "key", "fp"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, key binary, fp binary")


def alike(pairs: Iterator[tuple[np.ndarray, np.ndarray]], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The pairs of ``sets`` of similarity ``ALIKE`` or more that join what all such pairs join; the others of a joined group are not compared."""
    size, root, found = np.array([len(x) for x in sets]), list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    part, whole = ALIKE
    for i, j in pairs:
        ok = np.minimum(size[i], size[j]) * whole >= np.maximum(size[i], size[j]) * part
        for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both * whole >= (len(sets[a]) + len(sets[b]) - both) * part:
                    root[rb] = ra
                    found.append((a, b))
    return found


def exact_links(rough: DataFrame, docs: DataFrame, width: int, distance: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over ``rough`` (node, component, fp, key) that join what the pairs of a component join whose sets of shingles are alike.

    Each node's text is read back from ``docs`` by its key. A large component
    comes in tiles.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = pa.array([shingle_set(x.as_py(), width).tobytes() for x in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sets], ["node", "component", "fp", "shingles"])

    texts = keyed_texts(docs).select("key", "text")
    rows = rough.join(texts, "key").dropDuplicates(["key"]).select("node", "component", "fp", "text")
    rows = settled(rows.mapInArrow(shingled, "node long, component long, fp binary, shingles binary")).withColumn("own", F.lit(True))
    # All rows are home rows, so blocks i, j meet as j, i too.
    dealt = tiled(rows, ["component"], "own", "node", block).filter("hb <= mb")
    total = dealt.agg(F.sum(F.length("shingles") + 100)).first()[0] or 0
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("component", "hb", "mb"), F.lit(total // TASK_BYTES + 1)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pd.util.hash_pandas_object(pdf[["component", "hb", "mb"]], index=False).to_numpy()
        order = np.argsort(code, kind="stable")
        fp = np.frombuffer(b"".join(pdf["fp"].to_numpy()[order]), np.uint64).reshape(len(pdf), -1)
        node, role = pdf["node"].to_numpy()[order], pdf["role"].to_numpy()[order]
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"].to_numpy()[order]]
        found = np.array(alike(close_pairs(code[order], fp, role, distance), sets), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    return dealt.groupBy("bin").applyInPandas(run, "a long, b long")


def similar_documents(docs: DataFrame, width: int = 5, codes: int | None = None, distance: int = WIDE_DISTANCE, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id, key, group) of every row: groups that pairs of similarity 0.8 or more join, by their sets of five-word shingles.

    component_id is the group's smallest doc_id, ``key`` tells doc_id and text
    apart, ``group`` numbers the groups.

    The share of bits that differ estimates the angle between two sets;
    ``distance`` of 256 bits stands for a Jaccard similarity of 0.8 plus the
    estimate's spread. Pairs within it make rough groups, in which the sets are
    compared exactly: no pair below 0.8 is linked, and of pairs at 0.8 some two
    in a hundred are missed. Sets whose 256 bits are all equal are taken as alike.
    Treats nulls, blanks, repeated rows and empty
    tables as ``near_duplicates`` does.
    """
    prints = settled(wide_fingerprints(docs, width))
    firsts = numbered(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("key").alias("key")), "fp", "node")
    n = firsts.count()
    bits = code_bits(n)
    places = code_places(bits, codes or code_count(bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                fp = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1)
                for anchor in code_anchors(fp, places):
                    yield pdf.assign(anchor=anchor, own=True)

    rows = dealt_out(firsts.select("node", "fp"), n).mapInPandas(run, "node long, fp binary, anchor long, own boolean")
    rough = components(star_links(rows, distance, tile)).join(firsts, "node").select("node", "component", "fp", "key")
    comps = settled(components(exact_links(rough, docs, width, distance, block)))
    grouped = firsts.join(comps, "node", "left").select(F.col("fp").alias("_fp"), "first", F.coalesce("component", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(grouped.join(least, "root"), F.col("fp") == F.col("_fp")).select("doc_id", "component_id", "key", F.col("root").alias("group"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each group of similar documents: the smallest doc_id, nulls last, then the smallest key; columns as they were.

    Documents are told apart by doc_id and text together, so a doc_id that two
    texts share loses only what is a copy; rows equal in both are one document
    and stay or go together. Nulls, blanks and empty tables are as in
    ``similar_documents``; very long texts are compared whole.
    """
    groups = similar_documents(docs, **params)
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    best = groups.groupBy("group").agg(F.min(rank)["key"].alias("stays"))
    lost = groups.select("group", "key").distinct().join(best, "group").filter("key <> stays").select("key")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), document_key(F.col("doc_id"), text_bytes(F.col("text"))).alias("key"))
    return keyed.join(lost, "key", "left_anti").select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
