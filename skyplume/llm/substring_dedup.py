"""Repeated substrings by suffix arrays: removes each byte of a 200-byte string that also starts elsewhere.

1. Anchors. Every 200-byte window has a minimiser: the 100-byte gram of smallest
   hash in it, the first of equals. Equal windows have equal minimisers at equal
   places, so only grams that occur twice in the corpus can lie in a repeated
   window; they are counted by hash.
2. Pieces. Around each such anchor the bytes that its windows can reach are cut
   out of the text. Equal pieces are one row with a count.
3. Shards. The different pieces of an anchor come into one shard, many anchors
   to a shard of bounded size: a suffix array by Larsson-Sadakane refinement
   (only groups not yet sorted are sorted again), common prefixes of neighbours
   by Kasai's walk, run along all pieces at once. Neighbours with 200 bytes in
   common are one window; it is repeated if its pieces occur twice.
4. Merging. An anchor with more pieces than a shard holds is dealt to several;
   each hands on its windows in the order of their fingerprints, and shards are
   merged by binary search for what occurs in two of them, a range of
   fingerprints at a time. Windows that meet are compared in full; where
   fingerprints deceive, windows meet again by their bytes.
5. What is covered is joined back to the documents.

No step compares shards pairwise, and no key's rows come together unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyplume.llm.common import discard, freed_shuffles, settled, written

WINDOW = 200
GRAM = 100
#: Bytes that are hashed together; positions in them fit 21 bits.
BATCH = 1 << 20
#: Different pieces in a shard.
SHARD = 4096

_ODD = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


_POWER, _INVERSE = _powers(BATCH + WINDOW, _ODD), _powers(BATCH + WINDOW, pow(_ODD, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` bytes in a row."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWER[: len(raw)])))
    return _mix((total[size:] - total[:-size]) * _INVERSE[: len(raw) - size + 1])


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` values in a row: of each block's tail and the next one's head."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def minimisers(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the minimiser of each window of each text, each position once, in order.

    Texts are hashed together, up to BATCH bytes; longer ones in stretches that
    overlap by a window.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = np.uint64((1 << 21) - 1)

    def run(held: list[tuple[int, int, bytes]]) -> None:
        raw = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        if len(raw) < window:
            return
        h = gram_hashes(raw, gram)
        least = window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
        sizes = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(sizes)
        part = np.repeat(np.arange(len(held)), sizes)[: len(least)]
        inside = np.arange(len(least)) + window <= ends[part]
        p = np.unique(least[inside] & low).astype(np.int64)
        k = part[p] if len(p) == 0 or p[-1] < len(part) else np.searchsorted(ends, p, side="right")
        found.append((np.array([t for t, _, _ in held])[k], p - (ends - sizes)[k] + np.array([o for _, o, _ in held])[k], h[p]))

    held, size = [], 0
    for t, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), BATCH - window):
            x = text[at : at + BATCH]
            if size + len(x) > BATCH:
                run(held)
                held, size = [], 0
            held.append((t, at, x))
            size += len(x)
    if held:
        run(held)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, p, h = (np.concatenate([f[k] for f in found]) for k in range(3))
    again = np.concatenate(([False], (t[1:] == t[:-1]) & (p[1:] <= p[:-1])))
    if again.any():  # stretches of one text may show a position twice
        order = np.lexsort((p, t))
        t, p, h = t[order], p[order], h[order]
        once = np.concatenate(([True], (t[1:] != t[:-1]) | (p[1:] != p[:-1])))
        t, p, h = t[once], p[once], h[once]
    return t, p, h.view(np.int64)


def suffix_array(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``raw`` in order, and each one's place.

    Larsson-Sadakane: ranks by the first 8 bytes, then by twice as many each
    round; only suffixes whose rank is shared are sorted again. The order is
    total, as Kasai's walk needs it.
    """
    n = len(raw)
    key = _words(raw, ">u8")[:n]
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    # A group's rank is the place of its first suffix.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    done = 8
    while True:
        alone = np.concatenate((new[1:], [True])) & new
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        s = order[at]
        pair = rank[s] * (n + 1) + np.where(s + done < n, rank[np.minimum(s + done, n - 1)] + 1, 0)
        again = np.argsort(pair)
        s, pair = s[again], pair[again]
        order[at] = s
        split = np.concatenate(([True], pair[1:] != pair[:-1]))
        new[at] = split
        rank[s] = np.maximum.accumulate(np.where(split, at, 0))
        done *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def _words(raw: np.ndarray, kind: str) -> np.ndarray:
    """The 8 bytes from each position on as one number; zeros beyond the end."""
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(kind)[:, 0].astype(np.uint64)


def common_prefixes(raw: np.ndarray, order: np.ndarray, place: np.ndarray, first: np.ndarray, walk: np.ndarray, most: int) -> np.ndarray:
    """By place: bytes that a suffix has in common with the one before it, up to ``most``; 0 for suffixes beyond the walks.

    Kasai: a suffix has one byte less at least in common with its neighbour than
    the suffix that starts one byte before it had. The walks, ``walk`` steps from
    each ``first``, go side by side, eight bytes at a time.
    """
    n = len(raw)
    words = np.concatenate((_words(raw, "<u8"), np.zeros(most + 16, np.uint64)))
    lcp, held = np.zeros(n, np.int64), np.zeros(len(first), np.int64)
    for step in range(int(walk.max(initial=0))):
        live = np.flatnonzero(walk > step)
        i = first[live] + step
        p = place[i]
        j = order[np.maximum(p - 1, 0)]
        h = np.maximum(held[live] - 1, 0)
        go = np.flatnonzero(h < most)
        while len(go):
            differ = words[i[go] + h[go]] ^ words[j[go] + h[go]]
            # Equal bytes before the lowest bit that differs.
            bit = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64)
            h[go] += np.where(differ == 0, 8, bit >> 3)
            go = go[(differ == 0) & (h[go] < most)]
        h = np.where(p > 0, np.minimum(h, most), 0)
        held[live] = h
        lcp[p] = h
    return lcp


def window_classes(pieces: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, class) of every window of every piece; equal windows have equal classes."""
    size = np.array([len(p) for p in pieces])
    # No UTF-8 text has the byte 255, so what two windows have in common lies within their pieces.
    raw = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8)
    first = np.cumsum(size + 1) - size - 1
    n = np.maximum(size - window + 1, 0)
    order, place = suffix_array(raw)
    label = np.cumsum(common_prefixes(raw, order, place, first, n, window) < window)
    piece = np.repeat(np.arange(len(pieces)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return piece, start, label[place[first[piece] + start]]


def covered(start: np.ndarray, window: int) -> list[int]:
    """[from, to, from, to, ...] of the union of windows at the sorted ``start``."""
    if not len(start):
        return []
    cut = np.flatnonzero(np.diff(start) > window)
    return np.stack((start[np.concatenate(([0], cut + 1))], start[np.append(cut, len(start) - 1)] + window), axis=1).ravel().tolist()


def document_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """kh, kl and the arrays anchors, places of every row of ``docs`` (kh, kl, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, p, h = minimisers(b.column("raw").to_pylist(), window, gram)
            cuts = pa.array(np.searchsorted(t, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (h, p)]
            yield pa.RecordBatch.from_arrays([b.column("kh"), b.column("kl"), *lists], ["kh", "kl", "anchors", "places"])

    return docs.select("kh", "kl", "raw").filter(F.octet_length("raw") >= window).mapInArrow(run, "kh long, kl long, anchors array<long>, places array<long>")


def cut_pieces(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """kh, kl, anchor, place, left, piece of ``docs`` (kh, kl, raw, at: array of anchor and place)."""
    reach = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at")
            x, count = at.flatten(), np.diff(at.offsets.to_numpy())
            anchor, place = (x.field(c).to_numpy() for c in ("anchor", "place"))
            lo = np.maximum(place - reach, 0)
            texts = b.column("raw").to_pylist()
            pieces = [texts[k][i:j] for k, i, j in zip(np.repeat(np.arange(len(texts)), count).tolist(), lo.tolist(), (place + window).tolist(), strict=True)]
            keys = [np.repeat(b.column(c).to_numpy(), count) for c in ("kh", "kl")]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(anchor), pa.array(place), pa.array((place - lo).astype(np.int32)), pa.array(pieces, pa.binary())], ["kh", "kl", "anchor", "place", "left", "piece"])

    return docs.mapInArrow(run, "kh long, kl long, anchor long, place long, left int, piece binary")


def shard_windows(pdf: pd.DataFrame, window: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Windows of a shard's pieces (piece, anchor, shift against the anchor, n, class), and which are repeated within it."""
    piece, start, label = window_classes([bytes(p) for p in pdf["piece"]], window)
    w = pd.DataFrame({"piece": piece, "start": start, "anchor": pdf["anchor"].to_numpy()[piece], "shift": start - pdf["left"].to_numpy()[piece], "label": label, "n": pdf["n"].to_numpy()[piece]})
    # The same place against the anchor: one occurrence never meets itself.
    codes = np.unique(w["anchor"].to_numpy(), return_inverse=True)[1]
    key = (label * (codes.max(initial=0) + 1) + codes) * (4 * window) + w["shift"].to_numpy() + 2 * window
    back = np.unique(key, return_inverse=True)[1]
    return w, np.bincount(back, w["n"].to_numpy())[back] >= 2


def piece_runs(pdf: pd.DataFrame, w: pd.DataFrame, repeated: np.ndarray, window: int) -> pd.DataFrame:
    """(anchor, pd, runs): what of each piece is covered, against the anchor."""
    hit = w[repeated]
    cuts = np.flatnonzero(np.diff(hit["piece"].to_numpy())) + 1
    ids = hit["piece"].to_numpy()[np.concatenate(([0], cuts))] if len(hit) else np.zeros(0, np.int64)
    runs = [covered(x, window) for x in np.split(hit["shift"].to_numpy(), cuts)] if len(hit) else []
    return pd.DataFrame({"anchor": pdf["anchor"].to_numpy()[ids], "pd": pdf["pd"].to_numpy()[ids], "runs": pd.Series(runs, dtype=object)})


def part_windows(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """A part of a hot anchor's pieces: what it covers by itself (runs), and its different windows in order of their fingerprints.

    A window row has one piece that shows it; n = 2 where the part has it again:
    it is covered already and only a partner for other parts.
    """
    w, repeated = shard_windows(pdf, window)
    local = piece_runs(pdf, w, repeated & (pdf["n"].to_numpy()[w["piece"].to_numpy()] == 1), window)
    one = w.assign(again=repeated).drop_duplicates(["label", "shift"])
    # Two hashes of 64 bits, of the window and its place against the anchor.
    raw = np.frombuffer(b"".join(pdf["piece"]), np.uint8)
    first = np.cumsum([0, *(len(p) for p in pdf["piece"])])[:-1]
    at = first[one["piece"].to_numpy()] + one["start"].to_numpy()
    prints = [np.zeros(0, np.uint64)] * 2
    if len(one):
        prints = [_mix(_hash_at(raw, at, window, odd) + one["shift"].to_numpy().astype(np.uint64) * np.uint64(_ODD)) for odd in (_ODD, 0xC2B2AE3D27D4EB4F)]
    again = one["again"].to_numpy()
    anchor = pdf["anchor"].iloc[0]
    rows = pd.DataFrame({"anchor": anchor, "pd": pdf["pd"].to_numpy()[one["piece"].to_numpy()], "shift": one["shift"].to_numpy(), "hi": prints[0].view(np.int64), "lo": prints[1].view(np.int64), "n": again + 1})
    return pd.concat((local, rows.sort_values(["hi", "lo"])), ignore_index=True).assign(part=int(pdf["part"].iloc[0]))[["anchor", "part", "pd", "runs", "shift", "hi", "lo", "n"]].astype({"shift": "Int64", "hi": "Int64", "lo": "Int64", "n": "Int64"}).replace({"runs": {np.nan: None}})


def _hash_at(raw: np.ndarray, at: np.ndarray, size: int, odd: int) -> np.ndarray:
    """Polynomial hash of the ``size`` bytes at each of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(odd) + raw[at + k] + np.uint64(1)
    return out


def merge_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows of a range of fingerprints from all parts: those that another part has as well, with the piece of the first that has it.

    Each part comes in order. Parts are merged one by one: a part's windows are
    looked up in what is merged already by binary search, and new ones are put in
    their places.
    """
    pdf = pdf.sort_values(["part", "anchor", "hi", "lo"], ignore_index=True)
    key = np.rec.fromarrays([pdf[c].to_numpy(np.int64) for c in ("anchor", "hi", "lo")], names="anchor,hi,lo")
    # One number for each different key, in the keys' order.
    code = np.unique(key, return_inverse=True)[1].astype(np.int64)
    n, pd_ = pdf["n"].to_numpy(), pdf["pd"].to_numpy()
    merged, first = np.zeros(0, np.int64), np.zeros(0, np.int64)  # codes, and the row that has each first
    seen = n.astype(np.int64).copy()
    like = np.arange(len(pdf))
    cuts = np.flatnonzero(np.diff(pdf["part"].to_numpy())) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
        if hi == lo:
            continue
        mine = np.arange(lo, hi)
        at = np.searchsorted(merged, code[mine])
        found = (at < len(merged)) & (merged[np.minimum(at, max(len(merged) - 1, 0))] == code[mine]) if len(merged) else np.zeros(len(mine), bool)
        like[mine[found]] = first[at[found]]
        like[first[at[found]]] = mine[found]
        np.add.at(seen, first[at[found]], 1)
        merged, first = np.insert(merged, at[~found], code[mine[~found]]), np.insert(first, at[~found], mine[~found])
    # A window alone is its own partner; its number is its part's.
    hit = (seen >= 2) | (like != np.arange(len(pdf)))
    return pdf[["anchor", "pd", "shift"]].assign(like=pd_[like], own=n == 1)[hit]


def same_windows(hits: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """(anchor, pd, shift) of the ``hits`` whose bytes are those of the piece that they are ``like``; the others meet again by their bytes."""
    # Pieces that share a number in an anchor are all compared.
    known = pieces.select("anchor", "pd", "left", "piece")
    grouped = hits.filter("own").groupBy("anchor", "pd", "like").agg(F.collect_set("shift").alias("shifts"))
    rows = grouped.join(known, ["anchor", "pd"]).join(known.select("anchor", F.col("pd").alias("like"), F.col("left").alias("left2"), F.col("piece").alias("piece2")), ["anchor", "like"])
    cut = lambda piece, left, at: F.substring(F.col(piece), F.col(left) + at + 1, F.lit(window))
    same = F.filter("shifts", lambda x: cut("piece", "left", x) == cut("piece2", "left2", x))
    rows = settled(rows.select("anchor", "pd", "like", same.alias("same"), F.array_except("shifts", same).alias("odd")))
    found = rows.select("anchor", "pd", F.explode("same").alias("shift"))
    odd = rows.select("anchor", F.explode("odd").alias("shift")).distinct()
    if odd.isEmpty():
        return found
    again = hits.join(odd, ["anchor", "shift"]).join(known, ["anchor", "pd"]).withColumn("bytes", cut("piece", "left", F.col("shift")))
    again = again.groupBy("anchor", "shift", "bytes").agg(F.collect_set("pd").alias("pds"), F.bool_and("own").alias("once")).filter((F.size("pds") > 1) | ~F.col("once"))
    return found.union(again.select("anchor", F.explode("pds").alias("pd"), "shift"))


def covers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(kh, kl, cover) of the rows of ``docs`` (kh, kl, raw) with repeated windows: from, to, from, to, ... that may overlap."""
    spark = docs.sparkSession
    with freed_shuffles(spark):
        pieces, runs = _covered_pieces(spark, docs, window, gram, shard)
    return pieces.select("anchor", "pd", "kh", "kl", "place").join(runs, ["anchor", "pd"]).groupBy("kh", "kl").agg(F.flatten(F.collect_list(F.transform("runs", lambda r: r + F.col("place")))).alias("cover"))


def _covered_pieces(spark: SparkSession, docs: DataFrame, window: int, gram: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """All pieces, and (anchor, pd, runs) of those with repeated windows: from, to, ... against the anchor."""
    found, found_at = written(document_anchors(docs, window, gram), "anchors")
    each = found.select("kh", "kl", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("kh", "kl", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    shared = found.select(F.explode("anchors").alias("anchor")).groupBy("anchor").count().filter("count > 1").select("anchor")
    shared, shared_at = written(shared, "shared")  # read again, so that a hot anchor can be split in the join
    at = each.join(shared, "anchor").groupBy("kh", "kl").agg(F.collect_set(F.struct("anchor", "place")).alias("at"))
    # Rows equal in all bytes and ids have one key: their pieces are cut once for each.
    cut = docs.join(at, ["kh", "kl"]).select("kh", "kl", "raw", "at")
    pieces, _ = written(cut_pieces(cut, window, gram).withColumn("pd", F.xxhash64("left", "piece")).filter(F.octet_length("piece") >= window), "pieces")
    for path in (found_at, shared_at):
        discard(spark, path)
    different = pieces.groupBy("anchor", "left", "piece").agg(F.count("*").alias("n"), F.min("pd").alias("pd"))
    different, different_at = written(different, "different")
    per = settled(different.groupBy("anchor").agg(F.count("*").alias("k")))
    # Only anchors with more pieces than a shard holds; their number is checked.
    hot = per.filter(F.col("k") > shard).select(F.col("anchor").alias("_a"), F.ceil(F.col("k") / shard).cast("int").alias("parts"))
    n_hot = hot.count()
    whole = F.array(-F.col("left"), (F.octet_length("piece") - F.col("left")).cast("int"))
    known = "anchor long, pd long, runs array<int>"
    # Pieces that occur twice are covered whole.
    outs = [different.filter("n > 1").select("anchor", "pd", whole.alias("runs"))]
    rest = different.join(per.filter("k > 1").select("anchor", "k"), "anchor")
    bins = max(1, int(rest.count() // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, repeated = shard_windows(pdf, window)
        return piece_runs(pdf, w, repeated & (pdf["n"].to_numpy()[w["piece"].to_numpy()] == 1), window)

    cold = rest.filter(F.col("k") <= shard).withColumn("bin", F.pmod(F.xxhash64("anchor"), F.lit(bins)))
    outs.append(cold.groupBy("bin").applyInPandas(run, known))
    if n_hot:
        parts = different.join(F.broadcast(hot) if n_hot <= 50_000 else hot, F.col("anchor") == F.col("_a"))
        parts = parts.withColumn("part", F.pmod(F.col("pd"), F.col("parts")).cast("int")).drop("_a")
        shown, shown_at = written(parts.groupBy("anchor", "part").applyInPandas(lambda pdf: part_windows(pdf, window), "anchor long, part int, pd long, runs array<int>, shift int, hi long, lo long, n long"), "parts")
        outs.append(shown.filter("runs is not null").select("anchor", "pd", "runs"))
        # As many ranges of fingerprints as keep each to about 64 shards' windows; a window comes once from each part.
        windows = shown.filter("runs is null").select("anchor", "part", "pd", "shift", "hi", "lo", "n")
        bits = max(1, int(windows.count() // (64 * shard)).bit_length())
        hits = windows.withColumn("range", F.shiftright("hi", 64 - bits)).groupBy("range").applyInPandas(merge_parts, "anchor long, pd long, shift int, like long, own boolean")
        hits, hits_at = written(hits, "hits")
        hits = same_windows(hits, parts, window)
        outs.append(hits.groupBy("anchor", "pd").agg(F.flatten(F.transform(F.array_sort(F.collect_set("shift")), lambda s: F.array(s, s + window))).alias("runs")))
    result = outs[0]
    for o in outs[1:]:
        result = result.union(o)
    runs, _ = written(result, "runs")
    for path in [different_at, *([shown_at, hits_at] if n_hot else [])]:
        discard(spark, path)
    return pieces, runs


def union_of(cover: np.ndarray, size: int) -> np.ndarray:
    """[from, to] rows of the union of ``cover`` (from, to, from, to, ...)."""
    step = np.bincount(cover[::2], minlength=size + 1) - np.bincount(cover[1::2], minlength=size + 1)
    inside = np.cumsum(step) > 0
    return np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8))).reshape(-1, 2)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, removed (spans from, to in bytes) and kept (the remaining bytes) of every row of ``docs``.

    A null text is empty. Texts shorter than the window keep all bytes. Fully
    repeated rows count as two documents, so all their windows are repeated. An
    empty table gives no rows. Other columns are not read.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", raw).alias("kh"), F.xxhash64(raw, F.lit(1)).alias("kl"), raw.alias("raw"))
    found = covers(keyed, window, gram, shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept, texts = [], [], b.column("raw").to_pylist()
            cover = b.column("cover")
            values, offsets = cover.values.to_numpy(), cover.offsets.to_numpy()
            for text, lo, hi in zip(texts, offsets.tolist(), offsets[1:].tolist(), strict=False):
                edges = union_of(values[lo:hi], len(text)).tolist() if hi > lo else []
                spans.append(edges)
                outer = [0, *(x for e in edges for x in e), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(outer[::2], outer[1::2], strict=True)) if edges else text)
            cuts = pa.array(np.cumsum([0, *(len(x) for x in spans)]), pa.int32())
            flat = np.array([e for x in spans for e in x], np.int64).reshape(-1, 2)
            pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["from", "to"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.ListArray.from_arrays(cuts, pairs), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    rows = keyed.join(found, ["kh", "kl"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "raw", F.coalesce("cover", F.array().cast("array<long>")).alias("cover"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<from:long,to:long>>, kept binary")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = without_repeats(docs)
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
