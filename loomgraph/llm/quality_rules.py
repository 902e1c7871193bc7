"""Quality rules: plain limits, then robust multivariate outliers per language and source.

Minimum covariance determinant: of a group's documents, the share ``H`` whose covariance has the least determinant.
Each group has ``STARTS`` starts: centre and spread by medians, and the covariances of documents drawn by hash.  A
concentration step keeps the share ``H`` nearest to the current centre and estimates centre and covariance anew from
these.  All starts take ``FIRST`` steps; the one of the least determinant goes on until its determinant falls no more.
A step is one aggregation by (group, start, distance bin) over the small table of statistics; the rows of a group never
meet in one task, only its bins do.  A document is rejected if its Mahalanobis distance passes the ``TAIL`` quantile.
The length of a text isn't a fault: it enters as the divisor of the statistics, and the plain limits bound it.

Defined results: null text has no words; a null lang or source is a group of its own; groups under ``LEAST`` documents
are pooled by language, then over all; a pool still under ``LEAST`` rejects only by the plain limits; to each covariance
the squares in ``FLOOR`` are added, so statistics without spread, and ties, reject nobody; repeated rows count as often
as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .repeats import rolling

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT = 10, 0.20
H, LEAST = 0.75, 40
STARTS, FIRST = 4, 2
#: Fall of the determinant's logarithm under which a step counts as none.
STILL = 1e-4
#: Share of a clean normal group that would be rejected.
TAIL = 1e-8
#: Standard deviation added to each transformed statistic.
FLOOR = (0.06, 0.25, 0.25, 0.09)
DIMS = len(FLOOR)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    n = len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(seen[0x80:0xC0].sum()) - int(seen[list(SPACE)].sum())
    symbols = int(seen[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = 0
    if n > 5:
        h = rolling(np.fromiter(map(hash, words), np.int64, n).view(np.uint64), 5)
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(np.isin(h, twice))
            edge[at] += 1
            np.subtract.at(edge, at + 5, 1)
            repeats = int((np.cumsum(edge[:-1]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, lang, source, the statistics, and what is named in more."""
    C.small_batches(C.session_of(docs))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_text"), *more)
    keep = [f for f in base.schema.fields if f.name != "_text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{s} long" for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("_text")
            found = np.array([measure(t) for t in batch.column(i).to_pylist()], np.int64).reshape(-1, len(STATS))
            held = [(batch.schema.field(j).name, batch.column(j)) for j in range(batch.num_columns) if j != i]
            yield pa.RecordBatch.from_arrays([c for _, c in held] + [pa.array(found[:, j]) for j in range(len(STATS))], names=[n for n, _ in held] + list(STATS))

    return base.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEAT) * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics; the added 50 words keep short texts from standing out by chance."""
    n = F.col("n_words") + 50.0
    return [F.log((F.col("word_chars") + 250.0) / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(100 * F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def chi2_tail(x: float, dims: int) -> float:
    """Share beyond x of a chi-square with an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))


def chi2_quantile(tail: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dims) > tail else (low, mid)
    return low


def _cells(stats: DataFrame) -> DataFrame:
    """lang, source -> cell: the group itself, or the pool of small groups of its language, or of all."""
    small = F.col("n") < LEAST
    groups = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    pool = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    name = F.to_json(F.struct(F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0"))))
    return groups.withColumn("pool", pool).select(F.col("lang").alias("l"), F.col("source").alias("s"), F.when(~small, name).when(F.col("pool") >= LEAST, F.to_json(F.struct(F.coalesce("lang", F.lit("\0"))))).otherwise(F.lit("*")).alias("cell"))


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance from mu and prec (row by row) of the row's group."""
    d = [x[i] - F.col("mu")[i] for i in range(DIMS)]
    return sum((d[i] * d[j] * F.col("prec")[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)), F.lit(0.0))


_BINS_PER_LOG = 24


def _distance_bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-3) * _BINS_PER_LOG).cast("int")


def _start(each: DataFrame) -> DataFrame:
    """Centre and spread from medians, by histograms of 1/256 steps."""
    dims = each.select("cell", F.posexplode("x").alias("dim", "v")).select("cell", "dim", F.floor(F.col("v") * 256).cast("int").alias("bin"))
    hist = dims.groupBy("cell", "dim", "bin").agg(F.count(F.lit(1)).alias("n"))

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        mu, prec = np.zeros(DIMS), np.zeros((DIMS, DIMS))
        for k, g in pdf.groupby("dim"):
            v, n = g["bin"].to_numpy() / 256 + 1 / 512, g["n"].to_numpy()

            def middle(v: np.ndarray, n: np.ndarray) -> float:
                o = np.argsort(v)
                return float(v[o][np.searchsorted(np.cumsum(n[o]), n.sum() / 2)])

            mu[k] = middle(v, n)
            prec[k, k] = 1 / max(1.4826 * middle(abs(v - mu[k]), n), FLOOR[k]) ** 2
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "mu": [mu.tolist()], "prec": [prec.ravel().tolist()]})

    return hist.groupBy("cell").applyInPandas(centre, "cell string, mu array<double>, prec array<double>").withColumn("s", F.lit(0))


def _spread(cov: np.ndarray) -> tuple[list, float]:
    """The inverse with the floor, and the logarithm of the determinant."""
    cov = cov + np.diag(np.square(FLOOR))
    return np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def _drawn(each: DataFrame) -> DataFrame:
    """Starts from DIMS + 1 documents each, drawn by hash: from each of as many heaps the least hash."""
    heaps = DIMS + 1
    heap = lambda s: F.pmod(F.xxhash64("r", F.lit(-s)), F.lit(heaps))
    least = lambda s, j: F.min(F.when(heap(s) == j, F.struct(F.xxhash64("r", F.lit(s)).alias("h"), "x"))).alias(f"d{s}_{j}")
    points = each.groupBy("cell").agg(*[least(s, j) for s in range(1, STARTS) for j in range(heaps)])
    sets = [F.struct(F.lit(s).alias("s"), F.filter(F.array(*[F.col(f"d{s}_{j}.x") for j in range(heaps)]), lambda x: x.isNotNull()).alias("xs")) for s in range(1, STARTS)]

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs = [np.stack([np.asarray(x, float) for x in g]) for g in pdf["xs"]]
            found = [(g.mean(axis=0).tolist(), _spread(np.cov(g.T, bias=True).reshape(DIMS, DIMS) if len(g) > 1 else np.zeros((DIMS, DIMS)))[0]) for g in xs]
            yield pd.DataFrame({"cell": pdf["cell"], "mu": [m for m, _ in found], "prec": [q for _, q in found], "s": pdf["s"]})

    return points.select("cell", F.inline(F.array(*sets))).mapInPandas(estimate, "cell string, mu array<double>, prec array<double>, s int")


def _step(each: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step from each model (cell, s, mu, prec): the same with logdet, the determinant's logarithm."""
    x = [F.col("x")[i] for i in range(DIMS)]
    # AQE decides between broadcast and a join that splits the hot group
    rows = each.join(model.select("cell", "s", "mu", "prec"), "cell").withColumn("bin", _distance_bin(_distance(x)))
    pairs = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    sums = rows.groupBy("cell", "s", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(DIMS)], *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs])
    inner = 1 - chi2_tail(chi2_quantile(1 - H, DIMS), DIMS + 2)
    scale = H / inner

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        upto = int(np.searchsorted(pdf["n"].cumsum().to_numpy(), math.ceil(H * pdf["n"].sum())))
        part = pdf.iloc[: upto + 1]
        n = part["n"].sum()
        mu = np.array([part[f"s{i}"].sum() / n for i in range(DIMS)])
        cov = np.zeros((DIMS, DIMS))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = part[f"s{i}_{j}"].sum() / n - mu[i] * mu[j]
        cov = cov * scale
        cov[np.diag_indices(DIMS)] = np.maximum(cov.diagonal(), 0)
        prec, logdet = _spread(cov)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "s": [pdf["s"].iloc[0]], "mu": [mu.tolist()], "prec": [prec], "logdet": [logdet]})

    return sums.groupBy("cell", "s").applyInPandas(again, "cell string, s int, mu array<double>, prec array<double>, logdet double")


def concentrate(each: DataFrame, model: DataFrame) -> DataFrame:
    """cell, s, mu, prec, logdet: of all starts the best, after steps until its determinant falls no more."""
    for _ in range(FIRST):
        before, model = model, C.materialize(_step(each, model), "model")
        C.discard(before)
    best = F.min(F.struct("logdet", "s", "mu", "prec")).alias("m")
    model = C.materialize(model.groupBy("cell").agg(best).select("cell", "m.s", "m.mu", "m.prec", "m.logdet", F.lit(False).alias("still")), "model")
    while True:
        after = _step(each, model.where("not still")).select("cell", F.struct("mu", "prec", "logdet").alias("new"))
        both = model.join(after, "cell", "left").withColumn("fell", F.coalesce(F.col("new.logdet") < F.col("logdet") - STILL, F.lit(False)))
        pick = lambda n: F.when(F.col("fell"), F.col(f"new.{n}")).otherwise(F.col(n)).alias(n)
        before, model = model, C.materialize(both.select("cell", "s", pick("mu"), pick("prec"), pick("logdet"), (~F.col("fell")).alias("still")), "model")
        C.discard(before)
        if model.where("not still").isEmpty():
            return model


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups (l, s, cell) and their models (cell, mu, prec); documents that fail a plain limit don't count."""
    sound = stats.where(~base_failed())
    cells = C.materialize(_cells(sound), "cells")
    named = F.xxhash64("doc_id", *STATS).alias("r")
    each = sound.join(cells, sound["lang"].eqNullSafe(cells["l"]) & sound["source"].eqNullSafe(cells["s"])).select("cell", named, F.array(*vector()).alias("x"))
    each = C.materialize(each, "vectors")
    enough = each.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("cell")
    model = concentrate(each, C.materialize(_start(each).unionByName(_drawn(each)).join(enough, "cell"), "model"))
    C.discard(each)
    return cells, model.select("cell", "mu", "prec")


def judged(stats: DataFrame, tail: float = TAIL) -> DataFrame:
    """Adds base_failed, distance (squared; null without a model) and kept."""
    cells, model = fit(stats)
    rows = stats.join(cells, stats["lang"].eqNullSafe(cells["l"]) & stats["source"].eqNullSafe(cells["s"]), "left").drop("l", "s")
    rows = rows.join(model, "cell", "left").withColumn("distance", _distance(vector()))
    failed = base_failed()
    kept = ~failed & F.coalesce(F.col("distance") <= chi2_quantile(tail, DIMS), F.lit(True))
    return rows.drop("cell", "mu", "prec").withColumn("base_failed", failed).withColumn("kept", kept)


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, statistics, base_failed, distance, kept."""
    return judged(C.materialize(measured(docs), "stats"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of docs."""
    row = docs.select("doc_id", "lang", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return judged(C.materialize(measured(row, "_row"), "stats")).where("kept").select("_row.*")
