"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of a text in lower case (white space as one blank), hashed: one feature for an n-gram that
occurs, another for one that occurs again.  Each is scaled by its log-count ratio between toxic and other training texts;
a logistic regression is fitted on top.  The fit takes at most ``MOST`` rows of each class, chosen by a hash of the id
(the documented bound of the sample); scoring reads every whole text.

Defined results: null text counts as empty and is scored like one; without both classes every score is near the class
seen (0.5 without any); a document with several labels counts with each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .linear import fit_binary_features, sigmoid
from .repeats import columns

BITS = 22
ORDERS = (4, 5, 6, 7)
#: Bound of the training sample: rows of each class.
MOST = 1200
LEAST_DOCS, KEEP, L2 = 3, 20_000, 1e-3
_SLICE = 1 << 18


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashes of the character n-grams of a text, in slices so that long texts stay in bounds."""
    text = " " + " ".join(text.lower().split()) + " "
    top = max(ORDERS)
    for at in range(0, len(text), _SLICE):
        # a slice owns the n-grams that begin in it
        c = np.frombuffer(text[at : at + _SLICE + top - 1].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        own = min(_SLICE, len(text) - at)
        h = np.zeros(len(c), np.uint32)
        for k in range(1, top + 1):
            if len(c) < k:
                break
            h = h[: len(c) - k + 1] * np.uint32(0x01000193) ^ c[k - 1 :] * np.uint32(0x9E3779B1)
            if k in ORDERS:
                x = h[:own]
                x = (x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
                yield (x ^ x >> np.uint32(12)) * np.uint32(0x297A2D39 + 2 * k) >> np.uint32(32 - BITS)


def levels(hashes: np.ndarray) -> np.ndarray:
    """Feature numbers: 2 h for an n-gram that occurs, 2 h + 1 for one that occurs again."""
    h = np.sort(hashes)
    if not len(h):
        return h
    first = np.concatenate([[True], h[1:] != h[:-1]])
    second = np.concatenate([[False], ~first[1:] & first[:-1]])
    return np.sort(np.concatenate([2 * h[first], 2 * h[second] + np.uint32(1)]))


def present(text: str) -> np.ndarray:
    return levels(np.concatenate([*ngrams(text), np.zeros(0, np.uint32)]))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, toxic: at most ``most`` of each class, by a hash of the id, none held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(C.crc_fold(folds) != held)
    order = F.xxhash64("doc_id"), "doc_id"
    return known.where("toxic = 1").orderBy(*order).limit(most).union(known.where("toxic = 0").orderBy(*order).limit(most))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> dict:
    """The model: weights for at most ``KEEP`` hashed n-grams and a constant."""
    spark = C.session_of(docs)
    C.small_batches(spark)
    chosen = training_rows(docs, labels, most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(y, zlib.compress(np.diff(present(t), prepend=np.uint32(0)).tobytes(), 1)) for t, y in columns(b, "text", "toxic")]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], names=["y", "grams"])

    # at most 2 * most rows, and a row holds no more than the 2**23 features there are
    rows = C.bounded(texts, chosen, 2 * most, "toxic").mapInArrow(run, "y int, grams binary").collect()
    rows = sorted((r.y, bytes(r.grams)) for r in rows)
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else float(y[0])
        return {"keep": np.zeros(0, np.int64), "w": np.zeros(0), "b": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    def grams(packed: bytes) -> np.ndarray:
        return np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32), dtype=np.uint32)

    # rows are unpacked one at a time, and only features of enough rows get numbers of their own: small on the driver
    counts = np.zeros((2, 2 << BITS), np.uint16)
    for t, packed in rows:
        counts[t][grams(packed)] += np.uint16(1)
    often = np.flatnonzero(counts[0].astype(np.uint32) + counts[1] >= LEAST_DOCS)
    neg, pos = counts[0][often].astype(float), counts[1][often].astype(float)
    del counts
    p, q = (pos + 1.0) / (y.sum() + 2), (neg + 1.0) / ((1 - y).sum() + 2)
    ratio = np.log(p / q)
    telling = np.abs(ratio) * np.sqrt(pos / y.sum() + neg / (1 - y).sum())
    best = np.sort(np.argsort(-telling, kind="stable")[:KEEP])
    best = best[telling[best] > 0]
    keep, ratio = often[best], ratio[best]
    cols = [np.flatnonzero(np.isin(keep, grams(packed), assume_unique=True)).astype(np.int32) for _, packed in rows]
    r = np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols])
    w, b = fit_binary_features(r, np.concatenate(cols), y, ratio, L2)
    return {"keep": keep, "w": w, "b": b}


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    table = model.get("table")
    if table is None:  # once in each worker
        table = model["table"] = np.zeros(2 << BITS, np.float32)
        table[model["keep"]] = model["w"]
        model["known"] = table.reshape(-1, 2).any(axis=1)
    known, out = model["known"], np.zeros(len(texts))
    for i, t in enumerate(texts):
        hit = np.concatenate([x[known[x]] for x in ngrams(t)] or [np.zeros(0, np.uint32)])
        out[i] = float(table[levels(hit)].sum(dtype=np.float64))
    return sigmoid(out + model["b"])


def score(docs: DataFrame, model: dict, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = C.session_of(docs)
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = score_texts(b.column(b.schema.get_field_index("text")).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(found)], names=["doc_id", "score"])

    scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(C.crc_fold(folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
