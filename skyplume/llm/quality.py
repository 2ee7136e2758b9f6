"""Quality classifier: hashed word n-gram logistic regression, trained by follow the regularised leader.

Features are hashed n-grams over the words of a text: word 1- and 2-grams, and
1- to 3-grams over what words look like (letter case, digits, punctuation, a
word seen a moment ago). A text is scored by one sparse dot product of its
n-gram frequencies with the weights; hashing and counting run in NumPy over
many texts at once.

The model is fitted on a bounded sample of labelled documents (``SAMPLE``);
every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from skyplume.llm.common import free_name, sliced

BITS = 18
#: Labelled documents that the model is fitted on at most, first by the hash of doc_id.
SAMPLE = 3000
EPOCHS = 4
THRESHOLD = 0.3
#: Bytes that are hashed together; results do not depend on it.
BATCH = 1 << 19
#: How many words back a word counts as seen a moment ago.
RECENT = 8

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 punctuation
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[np.r_[65:91, 97:123, 128:256]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.full(BATCH + 2, _ODD, np.uint64))
_INVERSE = np.cumprod(np.full(BATCH + 2, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(codes: np.ndarray, doc: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of the runs of ``n`` codes that lie within a document."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(len(codes) - n + 1, salt, np.uint64)
    for k in range(n):
        h = _mix(h * _ODD + codes[k : len(codes) - n + 1 + k])
    inside = doc[: len(h)] == doc[n - 1 :]
    return h[inside], doc[: len(h)][inside]


def _units(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, kind, hash, capitals and first byte of the units of ``raw``: runs of bytes of one kind but space.

    The bytes are hashed BATCH at a time. A hash is a sum over a unit's bytes, so
    that a unit which a batch's end cuts gets the hash of the whole unit.
    """
    found, before = [], 0
    for at in range(0, len(raw), BATCH):
        part = raw[at : at + BATCH]
        kind = _KIND[part]
        first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        last = np.append(first[1:], len(part))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(_LOW[part].astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)])))
        ups = np.concatenate(([0], np.cumsum(_UPPER[part])))
        new = [first + at, last + at, kind[first], (total[last] - total[first]) * _INVERSE[first], ups[last] - ups[first], part[first]]
        if found and found[-1][2][-1] == new[2][0]:
            old = found[-1]
            before = int(old[1][-1] - old[0][-1])
            grown = (int(old[3][-1]) + int(new[3][0]) * pow(int(_ODD), before, 1 << 64)) % (1 << 64)
            old[1][-1], old[3][-1], old[4][-1] = new[1][0], grown, old[4][-1] + new[4][0]
            new = [x[1:] for x in new]
        if len(new[0]):
            found.append(new)
    out = [np.concatenate([f[k] for f in found]) for k in range(6)]
    solid = out[2] != 0
    return tuple(x[solid] for x in out)


def _features(part: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of texts; value: root of the gram's share in its family, so a family's values square up to 1."""
    raw = np.frombuffer(b"".join(x + b"\n" for x in part), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in part])
    first, last, kind, word, n_up, head = _units(raw)
    empty = np.zeros(0, np.int64)
    if not len(first):
        return empty, empty, np.zeros(0)
    size = last - first
    word = _mix(word + size.astype(np.uint64))
    doc = np.searchsorted(ends, first, side="right")
    glued = np.concatenate(([False], first[1:] == last[:-1]))
    seen = np.zeros(len(word), bool)
    for back in range(1, RECENT + 1):
        seen[back:] |= (word[back:] == word[:-back]) & (doc[back:] == doc[:-back]) & (size[back:] > 3)
    case = np.where(n_up == 0, 0, np.where((n_up == size) & (size > 1), 2, 1))
    # A punctuation run looks like its first character and its length.
    look = np.where(kind == 3, 64 + head.astype(np.int64) * 4 + np.minimum(size, 4) - 1, kind.astype(np.int64) * 16 + case * 4 + seen * 2 + glued)
    families = [(word, 1, 11), (word, 2, 12), (look.astype(np.uint64), 1, 21), (look.astype(np.uint64), 2, 22), (look.astype(np.uint64), 3, 23)]
    out = []
    for codes, n, salt in families:
        h, d = _grams(codes, doc, n, salt)
        key, count = np.unique((d.astype(np.uint64) << np.uint64(bits)) | (h >> np.uint64(64 - bits)), return_counts=True)
        d = (key >> np.uint64(bits)).astype(np.int64)
        out.append((d, (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.sqrt(count / np.bincount(d, count, len(part))[d])))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def features(texts: list[bytes], bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first index, number, document, feature, value) for runs of whole texts of some BATCH bytes together; a longer text is a run alone."""
    at, held, size = 0, [], 0
    for k, x in enumerate(texts):
        if held and size + len(x) + 1 > BATCH:
            yield at, len(held), *_features(held, bits)
            at, held, size = k, [], 0
        held.append(x)
        size += len(x) + 1
    if held:
        yield at, len(held), *_features(held, bits)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05) -> np.ndarray:
    """FTRL-proximal over sparse ``rows`` (features, values); the last weight is the intercept."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, v = np.append(rows[k][0], size - 1), np.append(rows[k][1], 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - labels[k]) * v
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            # Features of a row are distinct but where families meet by hash.
            np.add.at(z, i, g - step * w)
            np.add.at(n, i, g * g)
    return weights(np.arange(size))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Up to ``sample`` labelled (text, label) rows; never one with crc32(doc_id as text) mod 5 = 0."""
    marks = labels.withColumn("doc_id", F.col("doc_id").cast("long")).filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    marks = marks.filter(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text"))
    # `sample` rows at most: a checked size.
    return texts.join(F.broadcast(marks), F.col("_id") == F.col("doc_id")).groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("doc_id", "text", "label")


def fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1)) % 5


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> bytes:
    """Weights as float32 bytes. With no labelled rows all scores are 0.5.

    Texts become vectors where they are read; the one task that trains gets up to
    ``sample`` vectors, bounded however long the texts are.
    """

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, rows = [bytes(x) if x is not None else b"" for x in pdf["text"]], []
            for _, count, d, f, v in features(texts, bits):
                order = np.argsort(d, kind="stable")
                cuts = np.cumsum(np.bincount(d, minlength=count))[:-1]
                rows += [(x.astype(np.int32).tobytes(), y.tobytes()) for x, y in zip(np.split(f[order], cuts), np.split(v[order], cuts), strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "f": [r[0] for r in rows], "v": [r[1] for r in rows]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [x for x in batches if len(x)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values("doc_id", ignore_index=True)
        rows = [(np.frombuffer(f, np.int32).astype(np.int64), np.frombuffer(v)) for f, v in zip(pdf["f"], pdf["v"], strict=True)]
        yield pd.DataFrame({"w": [train(rows, pdf["label"].to_numpy(float), bits).astype(np.float32).tobytes()]})

    rows = training_rows(docs, labels, sample).mapInPandas(vectors, "doc_id long, label int, f binary, v binary").repartition(1)
    found = rows.mapInPandas(run, "w binary").collect()
    return bytes(found[0]["w"]) if found else np.zeros((1 << bits) + 1, np.float32).tobytes()


def score(docs: DataFrame, model: bytes, threshold: float = THRESHOLD, bits: int = BITS, names: tuple[str, str] = ("_score", "_predicted")) -> DataFrame:
    """All rows and columns of ``docs`` with a score (0 to 1) and a prediction (0 or 1) under ``names``.

    A null text scores as an empty one, blank texts by the intercept alone; texts
    of any length are one vector over the whole text. Repeated rows score alike,
    an empty table gives no rows. Columns of ``docs`` that have ``names`` are
    replaced: pass others to keep them.
    """
    docs = docs.drop(*names)
    raw = free_name(docs, "_raw")
    weights = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2^bits bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(weights.value, np.float32).astype(float)
        for b in sliced(batches):
            texts = [x.as_py() or b"" for x in b.column(raw)]
            s = np.full(len(texts), w[-1])
            for at, count, d, f, v in features(texts, bits):
                s[at : at + count] += np.bincount(d, w[f] * v, count)
            s = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            kept = [k for k, name in enumerate(b.schema.names) if name != raw]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*[b.schema.names[k] for k in kept], *names])

    schema = StructType([*docs.schema.fields]).add(names[0], DoubleType()).add(names[1], IntegerType())
    return docs.withColumn(raw, F.col("text").cast("binary")).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` or more, columns as they were, whatever they are called; nulls, repeats and empty tables as in ``score``."""
    names = free_name(docs, "_score"), free_name(docs, "_predicted")
    return score(docs, model, threshold, names=names).filter(F.col(names[1]) == 1).select(*docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
