"""Substrings, SimHash, token files, packing, classifier, embeddings, pipeline: brute force, round trips, held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skyplume.llm import binary_ids, common, embedding_dedup, packing, quality, simhash, substring_dedup, tokens
from tests.conftest import SF
from tests.llm.conftest import words

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def reach(n, pairs):
    """Smallest index that each of n nodes reaches."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# Shared helpers


def test_min_labels():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(2, 60), rng.integers(0, 60)
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        assert common.min_labels(n, a, b).tolist() == reach(n, zip(a, b, strict=True))


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    want = reach(600, pairs)
    assert got == {i: want[i] for a, b in pairs if a != b for i in (a, b)}


def test_numbers_of_keys_never_meet(spark):
    rows = spark.range(400).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"), "id")
    weak = lambda seed, key: F.pmod(F.xxhash64(F.lit(seed), key), F.lit(600 + 1000 * seed)) + F.lit(10**6 * seed)
    got = {r.key: r.number for r in common.numbered(rows, "key", "number", weak).collect()}
    assert len(got) == len(set(got.values())) == 400 and max(got.values()) > 10**6
    assert got == {r.key: r.number for r in common.numbered(rows.repartition(3), "key", "number", weak).collect()}
    plain = {r.key: r.number for r in common.numbered(rows, "key", "number").collect()}
    assert plain == {r.key: r.n for r in rows.select("key", F.xxhash64(F.lit(0), "key").alias("n")).collect()}
    with pytest.raises(RuntimeError, match="meet"):
        common.numbered(rows, "key", "number", lambda seed, key: F.lit(1), 3)


# 2


def brute_repeats(rows, window=200):
    seen = Counter(b[i : i + window] for _, b in rows for i in range(len(b) - window + 1))
    out = []
    for doc_id, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((str(doc_id), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard", [4096, 3])  # with 3, anchors are split over shards and merged
def test_substrings(spark, odd, none, shard):
    rng = random.Random(3)
    shared = [words(rng, 90) for _ in range(4)]
    more = [(2000 + i, words(rng, rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 50) : rng.randint(150, 400)] + words(rng, rng.randint(0, 60))) for i in range(40)]
    more += [(3000, "q" * 199), (3001, "q" * 199), (3002, "z" * 200), (3003, "z" * 201), (3004, "y" * 200)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = substring_dedup.without_repeats(docs, shard=shard).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert got == brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    assert substring_dedup.without_repeats(none).count() == 0


def test_windows_are_compared_in_full(spark, monkeypatch):
    """With fingerprints that are all alike, parts still meet by their bytes only."""
    merge = substring_dedup.merge_parts
    monkeypatch.setattr(substring_dedup, "merge_parts", lambda pdf: merge(pdf.assign(hi=0, lo=pdf["shift"].to_numpy())))
    rng = random.Random(8)
    shared = words(rng, 80).encode()[:260].decode(errors="ignore")
    docs = spark.createDataFrame([(i, f"{words(rng, 3)} {shared} {words(rng, 60)}") for i in range(8)], "doc_id long, text string")
    rows = substring_dedup.without_repeats(docs, shard=1).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in rows)
    assert got == brute_repeats([(r.doc_id, r.text.encode()) for r in docs.collect()])


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    raw = "".join(rng.choice("ab") for _ in range(900)).encode() + b"ab" * 300
    order, place = substring_dedup.suffix_array(np.frombuffer(raw, np.uint8))
    want = sorted(range(len(raw)), key=lambda i: raw[i:])
    assert order.tolist() == want and (order[place] == np.arange(len(raw))).all()
    lcp = substring_dedup.common_prefixes(np.frombuffer(raw, np.uint8), order, place, np.array([0]), np.array([len(raw) - 64]), 64)
    for k in range(1, len(raw)):
        a, b = raw[want[k - 1] :][:64], raw[want[k] :][:64]
        if want[k] < len(raw) - 64:
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_minimisers_of_long_texts_are_those_of_their_windows(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH", 700)
    text = words(random.Random(2), 900).encode()
    t, p, h = substring_dedup.minimisers([b"short", text, text])
    assert set(t) == {1, 2} and (np.diff(p[t == 1]) > 0).all() and p[t == 1].tolist() == p[t == 2].tolist()
    assert all(((p[t == 1] >= i) & (p[t == 1] <= i + 200 - substring_dedup.GRAM)).any() for i in range(len(text) - 199))


# 4


def brute_fingerprint(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(odd, none):
    docs = odd.collect()
    rows = simhash.near_duplicates(odd, tile=16).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in rows) == sorted((str(r.doc_id), brute_fingerprint(r.text, 3)) for r in docs)
    fps = [brute_fingerprint(r.text, 3) for r in docs]
    root = reach(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {k: min((r.doc_id for r, x in zip(docs, root, strict=True) if x == k and r.doc_id is not None), default=None) for k in root}
    assert sorted((str(r.doc_id), r.component_id) for r in rows) == sorted((str(r.doc_id), least[k]) for r, k in zip(docs, root, strict=True))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("tile", [4096, 64])
def test_links_lose_none(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 800, dtype=np.uint64) * np.uint64(2)
    fps = [base, np.zeros(1, np.uint64), np.full(1, 2**64 - 1, np.uint64)]
    for flips in (1, 2, 3):
        x = base[:400].copy()
        for _ in range(flips):
            x ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
        fps.append(x)
    dense = np.full(600, base[0])
    for _ in range(6):
        dense ^= np.uint64(1) << rng.integers(0, 10, 600).astype(np.uint64)
    u = np.unique(np.concatenate([*fps, dense]))
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 2)
    want = pd.Series(u.view(np.int64)).groupby(common.min_labels(len(u), i, j)).transform("min")
    found = common.components(simhash.links(spark.createDataFrame(pd.DataFrame({"fp": u.view(np.int64)})), 2, tile)).toPandas()
    at = dict(zip(found.node, found.component, strict=True))
    assert [at.get(x, x) for x in u.view(np.int64).tolist()] == want.tolist()


def test_similar_documents(spark, none):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        text = words(rng, 150).split()
        rows.append((k * 10, " ".join(text)))
        for c in range(1, 3):  # two words of 150 changed: a similarity of about 0.87
            near = list(text)
            for at in rng.sample(range(150), 2):
                near[at] = words(rng, 1) + "q"
            rows.append((k * 10 + c, " ".join(near)))
    rows += [(9000, None), (9001, ""), (9002, words(rng, 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert {k * 10 for k in range(40)} <= set(kept) and {9000, 9002} <= set(kept) and 9001 not in kept
    assert len(kept) <= 42 + 2  # all but a few of 80 near copies are gone
    assert simhash.similar_documents(none).count() == 0


def test_keep_one_tells_documents_by_id_and_text(spark):
    rng = random.Random(5)
    a, b = words(rng, 200), words(rng, 200)
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(1, a, "x"), (5, near, "x"), (5, b, "x"), (None, near, "x"), (None, b + " more", "x"), (None, words(rng, 90), "x"), (9, "", "x"), (9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _lost string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(tuple(r)[:2]) for r in kept.collect()) == sorted(map(str, [(1, a), (5, b), (None, rows[5][1]), (9, ""), (9, None)]))


def test_keep_one_on_odd_rows(odd, none):
    rows, kept = odd.collect(), simhash.keep_one(odd)
    assert kept.columns == odd.columns and simhash.keep_one(none).count() == 0
    sets = {(r.doc_id, r.text or ""): five_words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if (r.text or "").strip(" \t\n") else set() for r in rows}
    docs = list(sets)
    alike = lambda x, y: (not x and not y) or (bool(x and y) and jaccard(x, y) >= 0.8)
    root = reach(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if alike(sets[docs[i]], sets[docs[j]])])
    groups = {}
    for d, g in zip(docs, root, strict=True):
        groups.setdefault(g, []).append(d)
    got = {(r.doc_id, r.text or "") for r in kept.collect()}
    assert all(len(got & set(g)) == 1 for g in groups.values())
    for g in groups.values():
        known = [d[0] for d in g if d[0] is not None]
        assert not known or min(known) in {d[0] for d in got & set(g)}


def overlapping(rng, pairs, shared, own):
    """Fingerprints of pairs of sets that share ``shared`` shingles and have ``own`` each besides."""

    def prints(h):  # (sets, shingles) of hashes
        bits = np.unpackbits(h.view(np.uint8).reshape(*h.shape, -1), axis=2, bitorder="little")
        return np.packbits(bits.sum(axis=1, dtype=np.int64) * 2 > h.shape[1], axis=1, bitorder="little").view(np.uint64)

    h = rng.integers(0, 2**64, (pairs, shared + 2 * own, simhash.WIDE), np.uint64)
    return prints(h[:, : shared + own]), prints(np.concatenate([h[:, :shared], h[:, shared + own :]], axis=1))


def test_codes_find_pairs_in_tables_of_any_size():
    a, b = overlapping(np.random.default_rng(3), 1500, 160, 20)  # a similarity of 0.8
    for n in (1_000, 100_000, 1_000_000, 10_000_000, 100_000_000):
        bits = simhash.code_bits(n)
        places = simhash.code_places(bits, simhash.code_count(bits))
        met = np.zeros(len(a), bool)
        for x, y in zip(simhash.code_anchors(a, places), simhash.code_anchors(b, places), strict=True):
            met |= x == y
        assert met.mean() > 0.965, (n, met.mean())


def five_words(text):
    part = text.split()
    return {" ".join(part[k : k + 5]) for k in range(max(1, len(part) - 4))}


def jaccard(x, y):
    return len(x & y) / len(x | y)


def test_similar_documents_have_the_similarity(spark):
    rng = random.Random(17)
    rows, alike = [], {}
    for own in (30, 25, 20, 15):  # of 200 different shingles in both: similarities of 0.7, 0.75, 0.8 and 0.85
        for k in range(25):
            at = own * 1000 + k * 10
            common = words(rng, 204 - 2 * own)
            rows += [(at + c, " ".join([common, *(f"own{c}{k}" for k in range(own))])) for c in range(2)]
            alike[at] = jaccard(*(five_words(t) for _, t in rows[-2:]))
    line = words(rng, 8)  # counts of shingles agree, sets don't
    rows += [(90_000 + k, f"{line} " * 60 + words(rng, 30)) for k in range(2)]
    assert {round(x, 2) for x in alike.values()} == {0.7, 0.75, 0.8, 0.85}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(alike) <= kept and {90_000, 90_001} <= kept
    assert all(at + 1 in kept for at, x in alike.items() if x < 0.8)
    assert sum(at + 1 in kept for at, x in alike.items() if x >= 0.8) <= 3


def test_similar_documents_in_large_groups(spark):
    rng = random.Random(18)
    base, rows = words(rng, 200).split(), []
    for k in range(120):  # near copies of one document, alike or not
        near = list(base)
        for at in rng.sample(range(200), rng.randint(1, 8)):
            near[at] = words(rng, 1) + "q"
        rows.append((k, " ".join(near)))
    sets = [five_words(t) for _, t in rows]
    want = reach(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (7, simhash.BLOCK):
        found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, block=block).collect()}
        assert [found[k] for k in range(len(rows))] == want


# 6 and 8


def test_encoder_is_the_library():
    rng = random.Random(0)
    letters = "abcABC  \n\t'sstdmrvel!?.,1230²ß ÀéİŁǅſ<|endoftext|>_-\x1c\x85\xa0àéΣσ漢٣​"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["don't we'll I'm 'tis !!'s it's<|endoftext|>", "", "''s", "'S 'LL a'RE"]
    assert [x.tolist() for x in tokens.encoder("word_bpe_49k.json").ids(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_are_compared_in_full():
    """Words whose polynomial hashes are equal: Thue-Morse words and their mirror images."""
    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for n in (64, 1024, 2048, 4096):
        word = lambda a, b, n=n: "".join(b if i.bit_count() & 1 else a for i in range(n))
        texts = [word("a", "b") + " x " + word("b", "a"), "some words", word("b", "a"), word("a", "b"), word("b", "a") + word("a", "b")]
        for part in (texts, texts[::-1], texts[2:3]):  # in one batch and across batches
            assert [x.tolist() for x in encode.ids(part)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in part]
    for kind in ("latin-1", "utf-16-le"):
        letters = np.frombuffer("abcdefghijxabcdefghijyabcdabcd".encode(kind), np.uint8 if kind == "latin-1" else np.uint16)
        units = tokens.Units(letters, np.array([0, 11, 22, 26, 0]), np.array([11, 22, 26, 30, 10]))
        assert units.differ(np.array([0, 0, 2, 2, 0])).tolist() == [False, True, False, False, True]
        h = units.hashes()
        assert h[2] == h[3] and len(set(h.tolist())) == 4


def test_memory_of_units_is_bounded_by_bytes(monkeypatch):
    """Long units are not kept, and short ones only up to a number of bytes."""
    rng = random.Random(5)
    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    blob = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    texts = [f"before {blob(5000)} after" for _ in range(20)] + ["before after", blob(tokens.LONG), blob(tokens.LONG + 1)]
    assert [x.tolist() for x in encode.ids(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode.store.n == 3 and encode.store.bytes < 3000 and sum(map(len, encode.store.long.values())) == tokens.LONG
    monkeypatch.setattr(tokens, "KNOWN", 100_000)
    monkeypatch.setattr(tokens, "BATCH", 20_000)
    most = 0
    for _ in range(20):
        part = [" ".join(blob(rng.randint(1, 200)) for _ in range(100))]
        assert [x.tolist() for x in encode.ids(part)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in part]
        most = max(most, encode.store.bytes)
    assert 100_000 < most < 250_000


def test_sample_is_of_ids_and_its_texts(spark, odd, monkeypatch):
    monkeypatch.setattr(binary_ids, "SAMPLE", 12)
    some = binary_ids.sampled(odd)
    order = {r.doc_id: (h, r.doc_id is not None, r.doc_id or 0) for r in odd.select("doc_id").distinct().collect() for h in [odd.sparkSession.sql(f"select xxhash64({'cast(null as bigint)' if r.doc_id is None else f'{r.doc_id}L'})").first()[0]]}
    ids = sorted((r.doc_id for r in odd.collect()), key=lambda i: order[i])[:12]
    rows = some.collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, set(ids)))
    assert all(r.text == min((x.text for x in odd.collect() if x.doc_id == r.doc_id and x.text is not None), default=None) for r in rows)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and not any("text" in line for line in plan.splitlines() if "TakeOrderedAndProject" in line)


def test_colliding_units_go_to_the_library(monkeypatch):
    monkeypatch.setattr(tokens.Units, "hashes", lambda self: self.size.astype(np.uint64))
    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["one two six", "cat dog", "one", "", "four five"]
    for part in (texts, texts[::-1]):
        assert [x.tolist() for x in encode.ids(part)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in part]


def test_id_files_round_trip(spark, odd, none):
    path = common.fresh_path(spark, "test-ids")
    binary_ids.write_ids(odd, path)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in binary_ids.read_ids(spark, path).orderBy("start").collect()]
    want = sorted(((r.doc_id, LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted(map(str, ((d, i) for d, _, i in got))) == sorted(map(str, want))
    assert [d for d, _, _ in got] == [d for d, _ in want]
    assert [s for _, s, _ in got] == np.cumsum([0, *(len(i) for _, _, i in got)])[:-1].tolist()
    some = binary_ids.read_ids(spark, path, only=[5, 900]).collect()
    assert sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in some) == sorted(g for g in got if g[0] in (5, 900))
    blank = common.fresh_path(spark, "test-none")
    binary_ids.write_ids(none, blank)
    assert binary_ids.read_ids(spark, blank).count() == 0


def check_packed(rows, docs):
    want = {}
    for r in docs:
        want.setdefault(r.doc_id, []).append(LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [1])
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    expected = Counter()
    for doc_id, texts in want.items():
        for ids in texts:
            for at in range(0, len(ids), packing.LENGTH):
                part = np.array(ids[at : at + packing.LENGTH], "<u4")
                expected[(doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert pieces == expected
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist()
        assert sum(n for _, n in parts) <= packing.LENGTH
    return sum(r.length for r in rows) / (packing.LENGTH * len(by))


def test_packing_of_short_documents(spark):
    for size, least in ((17, 0.97), (1, 0.97), (129, 0.94)):  # 15 pieces of 129 tokens are 94.5 % of a sequence
        n = 40 * (packing.LENGTH // size)
        rows = packing.pack(spark.range(n).select(F.col("id").alias("doc_id"), F.lit(size).cast("long").alias("length")), ["doc_id"]).collect()
        assert len({r.doc_id for r in rows}) == len({(r.sequence_id, r.offset) for r in rows}) == n
        assert max(r.offset for r in rows) + size <= packing.LENGTH
        assert n * size / (packing.LENGTH * len({r.sequence_id for r in rows})) > least


def test_packing(spark, odd, none):
    check_packed(packing.packed_digest(odd).collect(), odd.collect())
    assert packing.packed_digest(none).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_packed(packing.packed_digest(docs).collect(), docs.collect()) > 0.95


def test_sequences_hold_the_ids(odd):
    pieces = packing.tokenized_pieces(odd)
    rows = packing.sequences(packing.pack(pieces, ["doc_id", "start", "length"]), pad_id=7).collect()
    assert all(len(r.ids) == 4 * packing.LENGTH for r in rows)
    ids = Counter(np.concatenate([np.frombuffer(r.ids, ">u4") for r in rows]).tolist())
    want = Counter(i for r in odd.collect() for i in LIBRARY.encode(r.text or "", add_special_tokens=False).ids + [1])
    ids.pop(7, None)
    want.pop(7, None)
    assert sum(ids.values()) == sum(want.values())


def test_pack_keeps_columns_of_any_name(spark):
    names = ["_class", "_slice", "_rank", "_row", "_length", "_by0", "_c", "_a", "_id", "_place", "_offset", "_n", "_before", "offset", "sequence_id", "text"]
    rows = [(k, 1 + 37 * k % 900, *[f"mine{k}"] * len(names)) for k in range(60)]
    out = packing.pack(spark.createDataFrame(rows, "id long, length int, " + ", ".join(f"{n} string" for n in names)), ["id"])
    assert out.columns == ["id", "length", *(n for n in names if n not in ("offset", "sequence_id")), "sequence_id", "offset"]
    got = out.collect()
    assert len(got) == 60 and all(r[n] == f"mine{r.id}" for r in got for n in names if n not in ("offset", "sequence_id")) and all(r["length"] == 1 + 37 * r.id % 900 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= packing.LENGTH


def test_plan_takes_each_piece_once():
    rng = np.random.default_rng(0)
    for n in (1, 5, 500, 20000):
        counts = Counter(rng.integers(1, 129, n).tolist())
        plans = packing.plan(dict(counts), 128)
        taken = Counter()
        for pattern, times in plans:
            assert times > 0 and sum(c * a for c, a in pattern.items()) <= 128
            for c, a in pattern.items():
                taken[c] += a * times
        assert taken == counts
    assert sum(t for _, t in plans) <= 1.01 * sum(c * k for c, k in counts.items()) / 128 + 1


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = np.unique(rng.integers(1, 12, 4))
        values = rng.random(len(sizes)) - 0.1
        best, counts = packing.knapsack(values, sizes, 20)
        table = [0.0] * 21
        for c in range(1, 21):
            table[c] = max([table[c - 1], *(table[c - s] + v for s, v in zip(sizes, values, strict=True) if s <= c)])
        assert best == pytest.approx(table[20]) and (counts * sizes).sum() <= 20 and (counts * values).sum() == pytest.approx(best)


# 9


def test_quality(spark, odd, none):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op9_quality(spark, sf).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95
    assert (held[held.quality == 1].predicted == 1).mean() >= 0.98
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    # Held-out labels have no say.
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    model = quality.fit(docs, labels)
    assert model == quality.fit(docs, other)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r._score <= 1 and r._predicted == (r._score >= 0.3) for r in rows)
    assert quality.score(none, model).count() == 0
    blank = quality.fit(docs, labels.filter("false"))
    assert {r._score for r in quality.score(odd, blank).collect()} == {0.5}


def test_features_do_not_depend_on_neighbours(monkeypatch):
    texts = [b"One two TWO two!! $$$", b"", b"alpha beta gamma 12", b"\n \t"]
    alone = [next(iter(quality.features([t])))[2:] for t in texts]
    _, n, d, f, v = next(iter(quality.features(texts)))
    assert n == 4
    for k, (_, fk, vk) in enumerate(alone):
        assert sorted(zip(f[d == k].tolist(), v[d == k].tolist(), strict=True)) == sorted(zip(fk.tolist(), vk.tolist(), strict=True))
    long = (words(random.Random(1), 400) + " " + "z" * 900 + " TWO two 12ab").encode()
    whole = list(quality.features([b"a b", long, b"c"]))
    monkeypatch.setattr(quality, "BATCH", 300)
    parts = list(quality.features([b"a b", long, b"c"]))
    assert [p[0] for p in whole] == [0] and [p[0] for p in parts] == [0, 1, 2]
    _, _, d, f, v = whole[0]
    for k, p in enumerate(parts):
        assert sorted(zip(f[d == k].tolist(), v[d == k].tolist(), strict=True)) == sorted(zip(p[3].tolist(), p[4].tolist(), strict=True))


def brute_word_grams(text):
    """Values of the word 1- and 2-grams of plain lower-case text."""
    w = text.split()
    return [sorted(np.sqrt(c / n) for c in Counter(tuple(w[k : k + n_]) for k in range(len(w) - n_ + 1)).values()) for n_, n in ((1, len(w)), (2, len(w) - 1))]


def test_values_are_roots_of_shares():
    text = "one two one three two one four"
    _, _, d, f, v = next(iter(quality.features([text.encode()], 30)))
    singles, pairs = brute_word_grams(text)
    assert sorted(v[:4]) == pytest.approx(singles) and sorted(v[4 : 4 + len(pairs)]) == pytest.approx(pairs)
    for n in (10, 1000, 50_000):  # however often a word repeats, no value is above 1
        assert next(iter(quality.features([b"word " * n])))[4].max() <= 1


def test_training_is_ftrl():
    """One feature at a time, by the published update."""
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 16, 5)), rng.random(16)) for _ in range(40)]
    rows = [(i, v[: len(i)]) for i, v in rows]
    labels = (rng.random(40) > 0.4).astype(float)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.01, 0.1
    z, n = [0.0] * 17, [0.0] * 17
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(40):
            x = dict(zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True)) | {16: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - labels[k]) * x[i]
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    got = quality.train(rows, labels, 4, 2, alpha, beta, l1, l2)
    assert got.tolist() == pytest.approx([weight(i) for i in range(17)])


def test_score_is_a_sparse_dot_product(spark, odd):
    weights = np.random.default_rng(2).normal(size=(1 << 10) + 1).astype(np.float32)
    for r in quality.score(odd, weights.tobytes(), bits=10).collect():
        _, _, _, f, v = next(iter(quality.features([(r.text or "").encode()], 10)))
        assert r._score == pytest.approx(1 / (1 + np.exp(-(float(weights[-1]) + sum(float(weights[i]) * x for i, x in zip(f, v, strict=True))))))


def test_accepted_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 0.123, "p", "r")], "doc_id long, text string, _score double, _predicted string, _raw string")
    blank = np.zeros((1 << quality.BITS) + 1, np.float32).tobytes()
    assert [tuple(r) for r in quality.accepted(docs, blank).collect()] == [(1, "a b", 0.123, "p", "r")]


# 10


def brute_vectors(v):
    n, pairs = len(v), []
    unit = []
    for x in v.embedding:
        ok = x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(c != 0 for c in x)
        x = np.array(x, float) / max(abs(c) for c in x) if ok else None  # squares of tiny components would be zero
        unit.append(x / np.linalg.norm(x) if ok else None)
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and v.label[i] == v.label[j] and unit[i] @ unit[j] >= 0.98:
                pairs.append((i, j))
    count = Counter(k for p in pairs for k in p)
    root = reach(n, pairs)
    least = {r: min(v.vec_id[k] for k in range(n) if root[k] == r) for r in root}
    return sorted((int(v.vec_id[k]), count[k], int(least[root[k]]), bool(v.vec_id[k] == least[root[k]])) for k in range(n))


@pytest.mark.parametrize("tile", [2048, 8])
def test_vectors(spark, tile):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(40):
        c = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            rows.append((c + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2]), k % 3))
    rows += [(rows[0][0], 0)] * 30 + [(rows[0][0] * 5, 0), (rows[0][0], 1)]
    rows += [(rows[0][0] + rng.normal(size=16) * 0.03, 0) for _ in range(60)]
    data = [(i, [float(x) for x in e], l) for i, (e, l) in enumerate(rows)]
    k = len(data)
    data += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [float("nan")] * 16, 0), (k + 3, [None] * 16, 0), (k + 4, [], 0), (k + 5, data[0][1], None), (k + 6, [1.0, 2.0], 0), (k + 7, [2.0, 4.0], 0), (k + 8, [1e-30] * 16, 2), (k + 9, [1e30] * 16, 2), (k + 10, [1e-170, 0.0], 2), (k + 11, [3e-300, 0.0], 2), (k + 12, [5e-324, 0.0], 2), (k + 13, [0.0, -0.0], 2)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in data], "vec_id long, embedding array<double>, label int, key string, n int")
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(df, tile=tile, leaf=20).collect())
    v = pd.DataFrame({"vec_id": [d[0] for d in data], "embedding": [d[1] for d in data], "label": pd.Series([d[2] for d in data], dtype=object)})

    v.loc[v.label.isna(), "label"] = [f"none{i}" for i in range(int(v.label.isna().sum()))]
    want = brute_vectors(v)
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.9 * links and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 0.02 * len(want)
    assert [g[1] for g in got if g[0] >= k + 10] == [2, 2, 2, 0]  # tiny is not zero
    assert embedding_dedup.near_vectors(df.filter("false")).count() == 0


def test_labels_of_other_types(spark):
    rows = [(k, [1.0, 0.01 * k], "ab"[k % 2] if k < 6 else None) for k in range(8)]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(k, 2, k % 2, k < 2) for k in range(6)] + [(6, 0, 6, True), (7, 0, 7, True)]


def test_routes_of_a_tree():
    rng = np.random.default_rng(3)
    x = embedding_dedup.units(rng.normal(size=(3000, 24)))
    spill = embedding_dedup.SPILL / 24**0.5
    splits = embedding_dedup.fit_node(x, len(x), 0, 1, spill, 100)
    row, node, own, done = embedding_dedup.route(x, np.ones(len(x), bool), splits, 0, 1, spill)
    assert sorted(row[own].tolist()) == list(range(len(x))) and len(set(zip(row.tolist(), node.tolist(), strict=True))) == len(row)
    assert len(row) < 1.5 * len(x)
    # Each node splits its own vectors in halves, along its own direction.
    sizes = Counter(node[own].tolist())
    assert max(sizes.values()) <= 100 and len(set(np.round(splits[2:8], 9))) == 6
    tight = embedding_dedup.units(np.ones((500, 24)) + rng.normal(size=(500, 24)) * 0.001)
    assert np.isnan(embedding_dedup.fit_node(tight, 500, 0, 1, spill, 100)).all()


def test_trees_follow_from_the_depth():
    counts = [embedding_dedup.tree_count(200 * 2**d) for d in (0, 1, 8, 20, 30)]
    assert counts == sorted(counts) and counts[0] == 1 and counts[-1] < 40


def test_spills_stay_few_in_many_dimensions():
    rng = np.random.default_rng(5)
    for dim in (64, 768):
        x = embedding_dedup.units(rng.normal(size=(2000, dim)))
        spill = embedding_dedup.SPILL / dim**0.5
        splits = embedding_dedup.fit_node(x, len(x), 0, 1, spill, 30)
        row = embedding_dedup.route(x, np.ones(len(x), bool), splits, 0, 1, spill)[0]
        assert len(row) / len(x) < 1.06**6 * 1.05  # 1.06 a level are 3.2 leaves at depth 20


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of cosine just above 0.98 in trees several levels deep."""
    rng = np.random.default_rng(7)
    a = embedding_dedup.units(rng.normal(size=(1500, 64)))
    b = embedding_dedup.units(rng.normal(size=(1500, 64)))
    b = embedding_dedup.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    near = 0.9805 * a + np.sqrt(1 - 0.9805**2) * b
    x = np.concatenate((a, near))
    df = spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, leaf=20).collect()}
    assert sum(got.values()) >= 0.99 * 3000 and max(got.values()) == 1


def test_vector_recall(spark):
    got = embedding_dedup.op10_embedding_dedup(spark, SF).toPandas().sort_values("vec_id")
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = brute_vectors(v)
    assert got.n_links.sum() >= 0.9 * sum(w[1] for w in want)
    assert [tuple(x) for x in got.itertuples(index=False)] == want


# Pipeline


def test_stages_on_odd_and_empty_tables(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, none):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert (out.count() == 0) == (docs is none), name
    assert corpus_pipeline.pack_sequences(spark, none, SF).count() == 0


def test_stages_are_their_plain_versions(spark):
    """Each stage on the whole of what the one before kept: scores, white space, shingle sets, word counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weights = np.frombuffer(model, np.float32).astype(float)

    def plain_score(text):
        _, _, _, f, v = next(iter(quality.features([(text or "").encode()])))
        return 1 / (1 + np.exp(-(weights[-1] + sum(weights[f] * v))))

    good = corpus_pipeline.reject_low_quality(spark, docs, SF)
    rows = good.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect() if plain_score(r.text) >= 0.3)
    first = {}
    for r in rows:
        norm, key = re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), (-len(r.text or ""), r.doc_id)
        first[norm] = min(first.get(norm, key), key)
    single = corpus_pipeline.drop_exact_copies(spark, good, SF)
    rows = single.collect()
    assert sorted(r.doc_id for r in rows) == sorted(k[1] for k in first.values())
    sets = [five_words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in rows]
    root = reach(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    want = {k: min(r.doc_id for r, x in zip(rows, root, strict=True) if x == k) for k in set(root)}
    apart = corpus_pipeline.drop_near_copies(spark, single, SF).collect()
    kept, wanted = {r.doc_id for r in apart}, set(want.values())
    assert wanted <= kept and len(kept - wanted) <= 0.1 * (len(rows) - len(wanted))  # recall of 0.9 at least, and no clean document is lost


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, at = [docs.count()], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, SF)
        assert out.columns == docs.columns
        path = common.fresh_path(spark, f"test-stage-{k}")
        out.write.parquet(path)
        at = spark.read.parquet(path)
        sizes.append(at.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] and sizes[4] > sizes[3]
    final = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert check_packed(final.collect(), at.collect()) > 0.9
    assert corpus_pipeline.run(spark, SF).count() == final.count()
