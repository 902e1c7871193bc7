"""Scores of predictions and of an embedding's distances x against hops y."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import SEED
from ..functions.stats import pearson
from ..plans.state import cut

EPS = 2.220446049250313e-16
H_STAR_TOL = 0.02
#: Ranks in a chunk of running counts.
CHUNK = 4096


def midranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the mean rank of each value, from 1.  Ranks come from counts by value: rows of the table are not sorted in one task."""
    per = cut(df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")), "values")
    per = running(per, col, "_n", "_upto")
    r = per.select(F.col(col).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(r, df[col].eqNullSafe(r["_v"])).drop("_v")


def running(per: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Running sum over the whole table: ranges sum first, then each adds what lies before it."""
    parts = per.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    parts = cut(parts, "ranges")
    sums = parts.groupBy("_p").agg(F.sum(value).alias("_s")).withColumn("_before", F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_s"))  # one row a range
    run = F.sum(value).over(Window.partitionBy("_p").orderBy(order))
    return parts.withColumn("_run", run).join(F.broadcast(sums.select("_p", "_before")), "_p").withColumn(out, F.col("_run") + F.col("_before")).drop("_p", "_run", "_before")


def classify_scores(df: DataFrame, y: str = "y", pred: str = "pred", prob: str = "prob") -> DataFrame:
    """accuracy, precision, recall, f1_score (0 where undefined), auc by midranks."""
    r = midranks(df, prob, "_r")
    hit = lambda c: F.sum(c.cast("double"))
    a = r.agg(hit((F.col(y) == 1) & (F.col(pred) == 1)).alias("tp"), hit((F.col(y) == 0) & (F.col(pred) == 1)).alias("fp"), hit((F.col(y) == 1) & (F.col(pred) == 0)).alias("fn"), hit(F.col(y) == F.col(pred)).alias("ok"), F.count(F.lit(1)).alias("n"), hit(F.col(y) == 1).alias("p"), F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("ranks"))
    ratio = lambda x, z: F.when(z > 0, x / z).otherwise(0.0)
    tp, fp, fn, p = (F.col(c) for c in ("tp", "fp", "fn", "p"))
    neg = F.col("n") - p
    return a.select((F.col("ok") / F.col("n")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"), F.when((p > 0) & (neg > 0), (F.col("ranks") - p * (p + 1) / 2) / (p * neg)).alias("auc"))


def regress_scores(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """mae, mre, rmse, r2, exact (the rounded prediction is right)."""
    e = F.col(pred) - F.col(y)
    a = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(EPS))).alias("mre"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.avg(e * e) / F.var_pop(y)).alias("r2"), F.avg((F.rint(pred) == F.col(y)).cast("double")).alias("exact"))
    return a


def _ranked(df: DataFrame, x: str) -> DataFrame:
    """Raise if one value holds over 90 % of the rows: ranks would say nothing."""
    top, n = df.groupBy(x).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"), F.sum("c")).first()
    if not n or top > 0.9 * n:
        raise ValueError(f"{x!r} is constant in over 90 % of the rows")
    return df


def spearman(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    r = midranks(midranks(df.select(x, y), x, "rx"), y, "ry")
    return r.agg(pearson("rx", "ry").alias("rho"))


def _concordance(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n0 pairs, c concordant, d discordant, tx, ty, txy tied pairs.

    Rows with equal (x, y) count once with their number; values become ranks; a merge over rank blocks counts
    discordant pairs: within blocks of y directly, between blocks from counts by x rank.
    """
    per = cut(df.groupBy(x, y).agg(F.count(F.lit(1)).alias("m")), "cells")
    tie = lambda *by: per.groupBy(*by).agg(F.sum("m").alias("t")).agg(F.sum(F.col("t").cast("double") * (F.col("t") - 1) / 2)).first()[0] or 0.0
    n = per.agg(F.sum("m")).first()[0] or 0
    n0, tx, ty, txy = n * (n - 1) / 2, tie(x), tie(y), tie(x, y)
    d = _inversions(per, x, y)
    c = n0 - tx - ty + txy - d
    return df.sparkSession.createDataFrame([(float(n0), float(c), float(d), float(tx), float(ty), float(txy))], "n0 double, c double, d double, tx double, ty double, txy double")


def _inversions(per: DataFrame, x: str, y: str) -> float:
    """Pairs with x1 < x2 and y1 > y2, weighed by counts.

    A binary tree over the y ranks as a table: a row belongs to log2(n) of its nodes, and in each counts the rows of the
    other half that lie before it by x, through running sums over chunks of x ranks and inside them.
    """
    ys = per.select(y).distinct()
    ys = running(ys.withColumn("_one", F.lit(1)), y, "_one", "ry").select(y, "ry")
    xs = running(per.select(x).distinct().withColumn("_one", F.lit(1)), x, "_one", "rx").select(x, "rx")
    cells = cut(per.join(ys, y).join(xs, x).select("rx", "ry", "m"), "ranked")
    top = cells.agg(F.max("ry")).first()[0] or 1
    levels = max(1, int(top).bit_length())
    # pairs with ry1 > ry2 part at the highest bit where they differ: ry1 has 1 there, ry2 has 0, and the bits above agree
    rows = cells.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    bit = F.expr("shiftright(ry, b) & 1")
    part = [F.sum(F.when(bit == v, F.col("m")).otherwise(0)).alias(n) for v, n in ((1, "ones"), (0, "zeros"))]
    # equal x don't count for each other, so a row a rank is enough; ranks go in chunks, as one node may hold all of them
    ranks = cut(rows.groupBy("b", F.expr("shiftright(ry, b + 1)").alias("node"), "rx").agg(*part).withColumn("chunk", F.floor(F.col("rx") / CHUNK)), "ranks")
    order = Window.partitionBy("b", "node").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = ranks.groupBy("b", "node", "chunk").agg(F.sum("ones").alias("ones")).select("b", "node", "chunk", F.coalesce(F.sum("ones").over(order), F.lit(0)).alias("earlier"))
    here = Window.partitionBy("b", "node", "chunk").orderBy("rx").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranks.withColumn("inside", F.coalesce(F.sum("ones").over(here), F.lit(0))).where("zeros > 0").join(chunks, ["b", "node", "chunk"])
    return float(counted.agg(F.sum(F.col("zeros").cast("double") * (F.col("earlier") + F.col("inside")))).first()[0] or 0.0)


def kendall_tau_b(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    c = _concordance(df, x, y)
    return c.select(((F.col("c") - F.col("d")) / F.sqrt((F.col("n0") - F.col("tx")) * (F.col("n0") - F.col("ty")))).alias("tau_b"))


def somers_d(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Of y given x: (C - D) / (pairs not tied in x)."""
    c = _concordance(df, x, y)
    return c.select(((F.col("c") - F.col("d")) / (F.col("n0") - F.col("tx"))).alias("somers_d"))


def tie_frac(df: DataFrame, y: str = "y") -> DataFrame:
    """Share of pairs tied in y; 0 for fewer than two rows."""
    per = df.groupBy(y).agg(F.count(F.lit(1)).cast("double").alias("t"))
    n = F.sum("t")
    return per.agg(F.when(n >= 2, F.sum(F.col("t") * (F.col("t") - 1)) / (n * (n - 1))).otherwise(0.0).alias("tie_frac"))


def tau_b_max(df: DataFrame, y: str = "y") -> DataFrame:
    """tau-b of a perfect layout without ties in x."""
    return tie_frac(df, y).select(F.sqrt(1 - F.col("tie_frac")).alias("tau_b_max"))


def per_shell(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """h, n, rho_cum (rows up to h), rho_shell (h and the shell before), x_mean, x_std, r2_shell.

    Every row is told off to the shells it counts for (as many as the diameter at most); all shells are ranked at once.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    base = rows.groupBy(F.col("y").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x_mean"), F.stddev_pop("x").alias("x_std"))
    shells = base.select("h", F.lag("h").over(Window.partitionBy(F.lit(0)).orderBy("h")).alias("before"))  # a row a shell
    shells = F.broadcast(cut(shells, "shells"))
    both = rows.join(shells, rows["y"] <= F.col("h")).select("h", "before", "x", "y", F.explode(F.array(F.lit("cum"), F.lit("one"))).alias("kind"))
    both = cut(both.where("before is not null and (kind = 'cum' or y = h or y = before)"), "rows")
    for v in ("x", "y"):
        per = both.groupBy("kind", "h", v).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("kind", "h").orderBy(v))
        both = both.join(per.select("kind", "h", v, (upto - (F.col("c") - 1) / 2.0).alias(f"r{v}")), ["kind", "h", v])
    got = both.groupBy("h", "kind").agg(pearson("rx", "ry").alias("rho"), F.pow(pearson("x", "y"), F.lit(2.0)).alias("r2"))
    side = lambda kind, *cols: got.where(F.col("kind") == kind).select("h", *cols)
    out = base.join(side("cum", F.col("rho").alias("rho_cum")), "h", "left").join(side("one", F.col("rho").alias("rho_shell"), F.col("r2").alias("r2_shell")), "h", "left")
    return out.select("h", "n", "rho_cum", "rho_shell", "x_mean", "x_std", "r2_shell")


def h_star(shells: DataFrame, tol: float = H_STAR_TOL) -> DataFrame:
    """The greatest h whose rho up to it is within tol of the best."""
    best = shells.agg(F.max("rho_cum").alias("best"))
    return shells.join(F.broadcast(best)).where(F.col("rho_cum") >= F.col("best") - tol).agg(F.max("h").alias("h_star"))  # one row


def bootstrap(df: DataFrame, score: Callable[[pd.DataFrame], float], resamples: int = 1000, seed: int = SEED, low: float = 2.5, high: float = 97.5, most: int = 2_000_000) -> DataFrame:
    """low, high: percentile interval of a score over resamples with replacement; a task holds one resample at a time.

    The rows are a measured sample of pairs that must fit a task: more than ``most`` raise.  Resamples are dealt among tasks.
    """
    if (n := df.count()) > most:
        raise ValueError(f"a bootstrap takes a sample of at most {most} rows, not {n}")
    rows = df.toPandas()
    shared = df.sparkSession.sparkContext.broadcast(rows)

    def run(batches):
        data = shared.value
        for b in batches:
            out = []
            for k in b["id"]:
                rng = np.random.default_rng([seed, int(k)])
                out.append(float(score(data.iloc[rng.integers(0, len(data), len(data))])))
            yield pd.DataFrame({"value": out})

    got = df.sparkSession.range(resamples).mapInPandas(run, "value double")
    return got.agg(F.percentile("value", F.lit(low / 100)).alias("low"), F.percentile("value", F.lit(high / 100)).alias("high"))


# stress
def stress1(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """scale (the best s in s * x) and stress1."""
    s = F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))
    a = df.agg(s.alias("scale"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    sc = F.col("scale")
    return a.select("scale", F.sqrt(F.greatest(sc * sc * F.col("xx") - 2 * sc * F.col("xy") + F.col("yy"), F.lit(0.0)) / F.col("yy")).alias("stress1"))


def distortion(df: DataFrame, scale: float, x: str = "x", y: str = "y") -> DataFrame:
    d = F.greatest(F.lit(scale) * F.col(x) / F.col(y), F.col(y) / F.greatest(F.lit(scale) * F.col(x), F.lit(EPS)))
    return df.select(d.alias("d")).agg(F.avg("d").alias("mean"), F.max("d").alias("max"), F.percentile("d", F.lit(0.99)).alias("p99"))


def pava(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Isotonic fit of y by rising x (already sorted, ties pooled)."""
    value, weight, size = [], [], []
    for a, b in zip(y, w, strict=True):
        value.append(float(a))
        weight.append(float(b))
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v, k, s = value.pop(), weight.pop(), size.pop()
            value[-1] = (value[-1] * weight[-1] + v * k) / (weight[-1] + k)
            weight[-1] += k
            size[-1] += s
    return np.repeat(value, size)


def isotonic_fit(df: DataFrame, x: str = "x", y: str = "y", tol: float = H_STAR_TOL) -> dict:
    """R2 of the best rising fit, the fitted hop where it becomes flat, the share of rows there.

    Equal x are pooled by Spark; pooling of neighbours runs over what remains, first within ranges, then over the
    ranges' blocks, which gives the same fit.
    """
    per = df.groupBy(F.col(x).alias("x")).agg(F.avg(F.col(y).cast("double")).alias("m"), F.count(F.lit(1)).cast("double").alias("w"))
    parts = cut(per.repartitionByRange("x").withColumn("p", F.spark_partition_id()), "ranges")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        fit = pava(pdf["x"].to_numpy(), pdf["m"].to_numpy(), pdf["w"].to_numpy())
        pdf = pdf.assign(f=fit, b=np.cumsum(np.concatenate([[0], np.diff(fit) != 0])))
        g = pdf.groupby("b").agg(p=("p", "first"), x0=("x", "min"), m=("f", "first"), w=("w", "sum")).reset_index(drop=True)
        return g[["p", "x0", "m", "w"]]

    blocks = parts.groupBy("p").applyInPandas(block, "p int, x0 double, m double, w double").toPandas().sort_values(["p", "x0"])
    fit = pava(blocks["x0"].to_numpy(), blocks["m"].to_numpy(), blocks["w"].to_numpy())
    n, mean, var = df.agg(F.count(F.lit(1)), F.avg(F.col(y).cast("double")), F.var_pop(F.col(y).cast("double"))).first()
    if not n:
        return {"isotonic_r2": float("nan"), "h_star": float("nan"), "share": float("nan")}
    between = float((blocks["w"] * (fit - mean) ** 2).sum() / n)
    flat = fit >= fit.max() - tol
    return {"isotonic_r2": between / var if var else float("nan"), "h_star": float(fit[flat].min()), "share": float(blocks["w"][flat].sum() / n)}


def shepard_pairs(df: DataFrame, keep: int = 5000, x: str = "x", y: str = "y") -> DataFrame:
    """At most ``keep`` points by rising x at an even stride."""
    n = df.count()
    stride = max(1, -(-n // keep))
    ranked = running(df.select(x, y, F.monotonically_increasing_id().alias("_i"), F.lit(1).alias("_one")), x, "_one", "_r")
    w = Window.partitionBy("_r").orderBy("_i")
    place = F.col("_r") - F.count(F.lit(1)).over(Window.partitionBy("_r")) + F.row_number().over(w) - 1
    return ranked.withColumn("place", place).where(F.col("place") % stride == 0).select(x, y)


# retrieval and groups
def recall_at(near: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Neighbours found among the k nearest over the most that could be, summed over all nodes with an edge."""
    e = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    hits = near.where(F.col("rank") <= k).join(e, ["id", "neighbour"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    most = e.groupBy("id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("m")).agg(F.sum("m").alias("most"))
    return hits.join(F.broadcast(most)).select((F.col("hits") / F.col("most")).alias("recall"))  # one row each


def retrieval(near: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Means over nodes with an edge of precision@k, recall@k, reciprocal rank, average precision, hit@k."""
    e = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    deg = e.groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    hit = near.where(F.col("rank") <= k).join(e.withColumn("hit", F.lit(1)), ["id", "neighbour"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    upto = F.sum("hit").over(Window.partitionBy("id").orderBy("rank"))
    per = hit.withColumn("upto", upto).groupBy("id").agg(F.sum("hit").alias("hits"), F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))).alias("rr"), F.sum(F.when(F.col("hit") == 1, F.col("upto") / F.col("rank"))).alias("ap"))
    both = deg.join(per, "id", "left").na.fill(0)
    return both.agg(F.avg(F.col("hits") / k).alias("precision"), F.avg(F.col("hits") / F.least("deg", F.lit(k))).alias("recall"), F.avg("rr").alias("mrr"), F.avg(F.col("ap") / F.least("deg", F.lit(k))).alias("map"), F.avg((F.col("hits") > 0).cast("double")).alias("hits_at_k"))


def knn_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean Jaccard similarity of two lists of neighbours."""
    sets = lambda d, n: d.groupBy("id").agg(F.collect_set("neighbour").alias(n))  # noqa: E731  k each
    j = sets(a, "a").join(sets(b, "b"), "id")
    return j.agg(F.avg(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(0.0)


def contingency(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))


def nmi(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Mutual information over the mean of both entropies."""
    t = cut(contingency(df, a, b), "table")
    h = lambda by: t.groupBy(by).agg(F.sum("n").alias("n")).agg(F.sum(_xlogx(F.col("n"))).alias(f"s_{by}"))
    all_ = t.agg(F.sum("n").alias("total"), F.sum(_xlogx(F.col("n"))).alias("s_ab"))
    j = all_.join(F.broadcast(h(a))).join(F.broadcast(h(b)))  # one row each
    n = F.col("total")
    ha, hb, hab = (F.log(n) - F.col(c) / n for c in (f"s_{a}", f"s_{b}", "s_ab"))
    return j.select(F.when(ha + hb > 0, 2 * (ha + hb - hab) / (ha + hb)).otherwise(1.0).alias("nmi"))


def ari(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adjusted Rand index."""
    t = cut(contingency(df, a, b), "table")
    two = lambda c: F.sum(c * (c - 1) / 2)
    side = lambda by: t.groupBy(by).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias(f"p_{by}"))
    j = t.agg(F.sum("n").alias("total"), two(F.col("n")).alias("p")).join(F.broadcast(side(a))).join(F.broadcast(side(b)))  # one row each
    pa, pb = F.col(f"p_{a}"), F.col(f"p_{b}")
    expect = pa * pb / (F.col("total") * (F.col("total") - 1) / 2)
    return j.select(F.when((pa + pb) / 2 != expect, (F.col("p") - expect) / ((pa + pb) / 2 - expect)).otherwise(1.0).alias("ari"))


def average_precision(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Area under precision over recall, equal scores together."""
    per = df.groupBy(score).agg(F.sum(F.col(y).cast("double")).alias("tp"), F.count(F.lit(1)).cast("double").alias("m")).withColumn("o", -F.col(score))
    per = running(per, "o", "tp", "ctp")
    per = running(per, "o", "m", "cm")
    return per.agg((F.sum(F.col("tp") * F.col("ctp") / F.col("cm")) / F.sum("tp")).alias("ap"))


def procrustes_rms(a: DataFrame, b: DataFrame, d: int) -> float:
    """Root mean square distance of two embeddings (id, vec) after centring, scaling and the best rotation.

    Rows meet by id; only sums of d * d products come to the driver.
    """
    j = a.select("id", F.col("vec").alias("va")).join(b.select("id", F.col("vec").alias("vb")), "id")
    va, vb = [F.col("va")[i] for i in range(d)], [F.col("vb")[i] for i in range(d)]
    r = j.agg(F.count(F.lit(1)), *[F.sum(x) for x in va + vb], F.sum(sum((x * x for x in va), F.lit(0.0))), F.sum(sum((x * x for x in vb), F.lit(0.0))), *[F.sum(x * y) for x in va for y in vb]).first()
    n, rest = r[0], [float(x) for x in r[1:]]
    ma, mb = np.array(rest[:d]) / n, np.array(rest[d : 2 * d]) / n
    na, nb = (max(rest[2 * d + i] - n * float(m @ m), 1e-300) for i, m in enumerate((ma, mb)))
    m = (np.array(rest[2 * d + 2 :]).reshape(d, d) - n * np.outer(ma, mb)) / np.sqrt(na * nb)
    trace = np.linalg.svd(m, compute_uv=False).sum()
    return float(np.sqrt(max(1 - trace * trace, 0) / n))


def neighbourhood_loss(high: DataFrame, low: DataFrame, n: int, k: int) -> DataFrame:
    """trustworthiness, continuity: ranks in one space of the neighbours found only in the other.

    high, low: id, neighbour, rank over all pairs within reach of k.
    """
    norm = 2.0 / (n * k * (2 * n - 3 * k - 1))
    j = high.select("id", "neighbour", F.col("rank").alias("rh")).join(low.select("id", "neighbour", F.col("rank").alias("rl")), ["id", "neighbour"])
    return j.agg((1 - norm * F.sum(F.when((F.col("rl") <= k) & (F.col("rh") > k), F.col("rh") - k).otherwise(0))).alias("trustworthiness"), (1 - norm * F.sum(F.when((F.col("rh") <= k) & (F.col("rl") > k), F.col("rl") - k).otherwise(0))).alias("continuity"))
