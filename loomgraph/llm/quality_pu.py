"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled good; the other set is unlabelled web text, a sample of all documents.  With the
class prior pi the risk is pi * E_pos[loss(+)] + max(0, E_unl[loss(-)] - pi * E_pos[loss(-)]); where the second part
falls below zero its gradient is turned round, which keeps the fit from explaining away the unlabelled text.

pi is estimated from positives and unlabelled rows alone, labels of bad rows are never read: a first classifier tells
one set from the other on half of each; on the other half, the least ratio of unlabelled to positive rows above any
score bounds the share of positives in the unlabelled set from above, and is close to it where the best scores are
given to positives only.

Features are learned weights of hashed character trigrams and ASCII characters, and the shape of words and lines.  The
fit takes at most ``MOST`` positives and ``MOST`` unlabelled rows, chosen by a hash of the id (the documented bound of
the sample); scoring reads every whole text.

Defined results: null text counts as empty and is scored like one; without positives or documents every score is 0.5;
an id that repeats counts with each of its texts; very long texts are read in slices; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .linear import Adam, sigmoid
from .repeats import columns

MOST = 8000
HIDDEN = 16
TRIGRAMS = 64
#: Positives that a score must have above it to bound the prior, as a share.
SUPPORT = 0.1
_SLICE = 1 << 20


def trigrams(data: bytes) -> np.ndarray:
    """Counts of hashed trigrams of bytes."""
    counts = np.zeros(TRIGRAMS, np.int64)
    for at in range(0, len(data) - 2, _SLICE):
        c = np.frombuffer(data[at : at + _SLICE + 2], np.uint8).astype(np.uint32)
        h = (c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]) * np.uint32(0x9E3779B1)
        counts += np.bincount(h >> np.uint32(32 - TRIGRAMS.bit_length() + 1), minlength=TRIGRAMS)
    return counts


def features(text: str) -> np.ndarray:
    """Shares of each ASCII character and hashed trigram, shape of words and lines; independent of language words."""
    data = text.encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    words = data.split()
    m = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    kinds = len(set(words)) / m
    upper, lower = seen[65:91].sum(), seen[97:123].sum()
    twice = 1 - len(set(lines)) / max(1, len(lines))
    more = [
        upper / (upper + lower + 1), seen[48:58].sum() / n, seen[0x80:].sum() / n, np.log1p(len(words)), np.log1p(n / m), kinds, twice,
        np.log1p(len(lines)), np.log1p(m / max(1, len(lines))), sum(1 for w in words if len(w) == 1) / m, (m - kinds * m) / m * np.log1p(m),
        (np.log1p(m) - np.log1p(kinds * m)),
    ]
    return np.concatenate([np.sqrt(seen[32:128] / n), np.sqrt(trigrams(data) / n), more]).astype(np.float32)


def _features_of(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array([features(t).tobytes() for (t,) in columns(b, "text")], pa.binary())], names=["doc_id", "x"])

    got = rows.mapInArrow(run, "doc_id long, x binary").collect()
    got = sorted((r.doc_id, bytes(r.x)) for r in got)
    return np.stack([np.frombuffer(x, np.float32) for _, x in got]) if got else np.zeros((0, 0), np.float32)


def _scaled(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / std, -6, 6)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, epochs: int = 150) -> float:
    """An upper bound of the share of positives in the unlabelled rows (scaled features of both)."""
    x = np.concatenate([pos[::2], unl[::2]])
    y = np.concatenate([np.ones(len(pos[::2])), np.zeros(len(unl[::2]))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b, adam = np.zeros(x.shape[1]), 0.0, Adam(x.shape[1] + 1, 0.02)
    for _ in range(epochs):
        r = weight * (sigmoid(x @ w + b) - y)
        step = adam.step(np.append(x.T @ r + 1e-3 * w, r.sum()))
        w, b = w - step[:-1], b - step[-1]
    p, u = np.sort((pos[1::2] if len(pos) > 1 else pos) @ w), np.sort((unl[1::2] if len(unl) > 1 else unl) @ w)
    cuts = np.quantile(p, np.linspace(0, 1 - SUPPORT, 200))
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = np.argmin((above_u + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.02, 0.98))


def fit(pos: np.ndarray, unl: np.ndarray, epochs: int = 400, l2: float = 1e-3) -> dict:
    """A network with one small hidden layer beside a linear part, trained on the non-negative risk."""
    mean, std = unl.mean(axis=0), unl.std(axis=0) + np.float32(1e-2)
    pos, unl = _scaled(pos, mean, std), _scaled(unl, mean, std)
    prior = estimate_prior(pos, unl)
    x, k = np.concatenate([pos, unl]).astype(np.float32), len(pos)
    d = x.shape[1]
    rng = np.random.default_rng(0)
    shape = {"w": (d,), "b": (1,), "u": (d, HIDDEN), "c": (HIDDEN,), "v": (HIDDEN,)}
    p = {n: rng.normal(0, 0.05, s) if n in "uv" else np.zeros(s) for n, s in shape.items()}
    p["b"][0] = np.log(prior / (1 - prior))
    adams = {n: Adam(int(np.prod(s)), 0.01) for n, s in shape.items()}
    for _ in range(epochs):
        q = {n: v.astype(np.float32) for n, v in p.items()}
        h = np.tanh(x @ q["u"] + q["c"])
        z = x @ q["w"] + h @ q["v"] + q["b"][0]
        s = sigmoid(z)
        minus = np.logaddexp(0, z)  # loss of calling it bad
        rest = minus[k:].mean() - prior * minus[:k].mean()
        dz = np.zeros(len(z), np.float32)
        if rest >= 0:
            dz[:k] = prior * (s[:k] - 1) / k - prior * s[:k] / k
            dz[k:] = s[k:] / (len(z) - k)
        else:
            dz[:k] = prior * s[:k] / k
            dz[k:] = -s[k:] / (len(z) - k)
        back = np.outer(dz, q["v"]) * (1 - h * h)
        grads = {"w": x.T @ dz + l2 * p["w"], "b": np.array([dz.sum()]), "u": x.T @ back + l2 * p["u"], "c": back.sum(axis=0), "v": h.T @ dz + l2 * p["v"]}
        for n, g in grads.items():
            p[n] = p[n] - adams[n].step(g.ravel()).reshape(shape[n])
    return {"prior": prior, "mean": mean, "std": std, **p}


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, folds: int = 3, held: int = 1) -> dict:
    """The model, from positives and unlabelled rows that aren't held out."""
    C.small_batches(C.session_of(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality = 1 and doc_id is not null").where(C.crc_fold(folds) != held)
    order = F.xxhash64("doc_id"), "doc_id"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trusted = known.select("doc_id").distinct().orderBy(*order).limit(most)
    anyone = texts.select("doc_id").where("doc_id is not null").where(C.crc_fold(folds) != held).distinct().orderBy(*order).limit(most)
    # at most ``most`` rows each, of a fixed number of features
    pos, unl = (_features_of(C.bounded(texts, ids, most)) for ids in (trusted, anyone))
    return fit(pos, unl) if len(pos) and len(unl) else {"prior": 0.5}


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    if "w" not in model or not texts:
        return np.full(len(texts), model["prior"])
    x = _scaled(np.stack([features(t) for t in texts]), model["mean"], model["std"])
    return sigmoid(x @ model["w"] + np.tanh(x @ model["u"] + model["c"]) @ model["v"] + model["b"][0])


def score(docs: DataFrame, model: dict, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    spark = C.session_of(docs)
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = score_texts(b.column(b.schema.get_field_index("text")).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(C.crc_fold(folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
