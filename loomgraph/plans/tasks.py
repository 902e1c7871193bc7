"""Evaluation tasks: a graph and an embedding -> a report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import build as B
from ..operators import graph as G
from ..operators import guards as C
from ..operators import paths as D
from ..operators import sampling as S
from ..operators import scores as M
from ..sources.files import load_embedding, load_graph
from . import protocols as P
from .report import Report, TaskResult
from .state import cut

TASKS: dict[str, Callable] = {}


def register(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        if name in TASKS:
            raise KeyError(f"task {name!r} is there already")
        TASKS[name] = f
        return f

    return add


def keywords(name: str) -> set[str]:
    """The settings a task takes: those of its protocol."""
    return set(asdict(getattr(P.Protocol(), name)))


def _ranked_nodes(edges: DataFrame) -> DataFrame:
    return cut(G.id_map(edges).select(F.col("raw").alias("id"), F.col("id").alias("rank")), "nodes")


def link_pairs(edges: DataFrame, cfg: P.LinkPrediction, seed: int) -> DataFrame:
    """u, v, y: edges and as many non-edges."""
    pos = cut(S.positives(edges, cfg.max_pairs, seed, cfg.pos_draw), "pos")
    want = int(pos.count() * cfg.neg_ratio)
    nodes = _ranked_nodes(edges)
    neg = S.distinct_negatives(nodes, edges, want, seed) if cfg.neg_draw == "far_pairs" else S.negatives(nodes, edges, want, seed)
    return pos.withColumn("y", F.lit(1)).union(neg.select("u", "v").withColumn("y", F.lit(0)))


def classifier(name: str, trees: int, seed: int):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    if name == "rf":
        return RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=10, seed=seed)
    if name == "logreg":
        return LogisticRegression(labelCol="y", featuresCol="features", maxIter=1000)
    raise KeyError(f"unknown model {name!r}; there are rf, logreg")


@register("link_prediction")
def link_prediction(edges: DataFrame, z: DataFrame, cfg: P.LinkPrediction, seed: int, strict: bool) -> TaskResult:
    warn = [C.check_shape(z, G.nodes_of(edges).count(), strict)]
    pairs = cut(link_pairs(edges, cfg, seed), "pairs")
    warn += [C.check_finite(z, strict), C.check_zero_rows(z, strict), C.check_class_balance(pairs, "y", strict)]
    x = V.feature(pairs, z, cfg.feature).withColumn("features", array_to_vector("feature"))
    x = cut(S.train_test(x.select("u", "v", F.col("y").cast("double").alias("y"), "features"), "y", cfg.test_size, seed), "features")
    model = classifier(cfg.model, cfg.n_estimators, seed).fit(x.where("not test"))
    out = model.transform(x.where("test")).select("y", F.col("prediction").alias("pred"), vector_to_array("probability")[1].alias("prob"))
    return TaskResult("link_prediction", asdict(cfg), M.classify_scores(cut(out, "scored")).first().asDict(), {"pairs": pairs.count()}, warnings=[w for w in warn if w])


class Mlp:
    """A small network for regression on one or a few columns, trained by Adam on the driver's sample."""

    def __init__(self, hidden: tuple[int, ...], seed: int, epochs: int = 200, early: bool = True) -> None:
        self.hidden, self.rng, self.epochs, self.early = hidden, np.random.default_rng(seed), epochs, early

    def fit(self, x: np.ndarray, y: np.ndarray) -> Mlp:
        self.mx, self.sx, self.my, self.sy = x.mean(0), x.std(0) + 1e-9, y.mean(), y.std() + 1e-9
        x, y = (x - self.mx) / self.sx, (y - self.my) / self.sy
        sizes = [x.shape[1], *self.hidden, 1]
        self.w = [self.rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        hold = self.rng.random(len(x)) < 0.1 if self.early and len(x) > 50 else np.zeros(len(x), bool)
        tx, ty, vx, vy = x[~hold], y[~hold], x[hold], y[hold]
        m = [np.zeros_like(p) for p in self.w + self.b]
        v = [np.zeros_like(p) for p in self.w + self.b]
        best, stale, t = np.inf, 0, 0
        for _ in range(self.epochs):
            for at in np.array_split(self.rng.permutation(len(tx)), max(1, len(tx) // 200)):
                acts = [tx[at]]
                for w, b in zip(self.w[:-1], self.b[:-1]):
                    acts.append(np.maximum(acts[-1] @ w + b, 0))
                d = (acts[-1] @ self.w[-1] + self.b[-1] - ty[at][:, None]) / len(at)
                gw, gb = [], []
                for i in range(len(self.w) - 1, -1, -1):
                    gw.insert(0, acts[i].T @ d)
                    gb.insert(0, d.sum(0))
                    d = (d @ self.w[i].T) * (acts[i] > 0)
                t += 1
                for k, (p, g) in enumerate(zip(self.w + self.b, gw + gb)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p -= 1e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            if hold.any():
                loss = float(((self._run(vx) - vy) ** 2).mean())
                best, stale = (loss, 0) if loss < best - 1e-4 else (best, stale + 1)
                if stale >= 10:
                    break
        return self

    def _run(self, x: np.ndarray) -> np.ndarray:
        for w, b in zip(self.w[:-1], self.b[:-1]):
            x = np.maximum(x @ w + b, 0)
        return (x @ self.w[-1] + self.b[-1])[:, 0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._run((x - self.mx) / self.sx) * self.sy + self.my


def hop_pairs(edges: DataFrame, cfg, seed: int) -> DataFrame:
    """u, v, hops for a protocol's draw."""
    nodes = _ranked_nodes(edges)
    pairs = cut(S.pairs_for_hops(nodes, edges, cfg.n_pairs, cfg.n_sources, cfg.pair_draw, seed), "pairs")
    return pairs if "hops" in pairs.columns else cut(D.hop_distance(edges, pairs, "bfs"), "hops")


@register("dist_approx")
def dist_approx(edges: DataFrame, z: DataFrame, cfg: P.DistanceApproximation, seed: int, strict: bool) -> TaskResult:
    drawn = hop_pairs(edges, cfg, seed)
    warn = [C.check_reachability(drawn, "hops", strict)]
    kept = drawn.where(F.col("hops") >= cfg.min_hop)
    warn += [C.check_target_spread(kept, "hops", strict), C.check_target_degeneracy(kept, "hops", strict), C.check_sample_shortfall(kept.count(), cfg.n_pairs, strict)]
    x = V.distance(kept, z, cfg.metric).withColumn("f", F.array("dist")) if cfg.feature == "distance" else V.feature(kept, z, "l1").withColumnRenamed("feature", "f")
    x = cut(S.train_test(x.select("u", "v", F.col("hops").cast("double").alias("y"), "f").withColumn("one", F.lit(1)), "one", cfg.test_size, seed).withColumn("features", array_to_vector("f")), "x")
    train, test = x.where("not test"), x.where("test")
    scores: dict[str, dict] = {}
    for name in cfg.models:
        if name == "baseline":
            mean = train.agg(F.avg("y")).first()[0]
            out = test.select("y", F.lit(mean).alias("pred"))
        elif name == "rf":
            from pyspark.ml.regression import RandomForestRegressor

            out = RandomForestRegressor(labelCol="y", featuresCol="features", numTrees=cfg.n_estimators, minInstancesPerNode=cfg.min_leaf, seed=seed).fit(train).transform(test).select("y", F.col("prediction").alias("pred"))
        else:
            a, b = train.select("f", "y").toPandas(), test.select("f", "y").toPandas()  # a drawn sample of pairs
            net = Mlp(cfg.hidden, seed, early=cfg.early_stopping).fit(np.stack(a["f"]), a["y"].to_numpy())
            out = edges.sparkSession.createDataFrame([(float(y), float(p)) for y, p in zip(b["y"], net.predict(np.stack(b["f"])))], "y double, pred double")
        scores[name] = M.regress_scores(out).first().asDict()
    sizes = {"pairs": kept.count(), "hops": {str(r.hops): r["count"] for r in kept.groupBy("hops").count().collect()}}
    return TaskResult("dist_approx", asdict(cfg), scores, sizes, warnings=[w for w in warn if w])


def _distances_and_hops(edges, z, cfg, seed) -> DataFrame:
    pairs = hop_pairs(edges, cfg, seed).where(F.col("hops") >= getattr(cfg, "min_hop", 1))
    return cut(V.distance(pairs, z).select(F.col("dist").alias("x"), F.col("hops").cast("double").alias("y"), "u"), "xy")


@register("dist_rank")
def dist_rank(edges: DataFrame, z: DataFrame, cfg: P.Ranking, seed: int, strict: bool) -> TaskResult:
    xy = M._ranked(_distances_and_hops(edges, z, cfg, seed), "x")
    tie, best = M.tie_frac(xy).first()[0], M.tau_b_max(xy).first()[0]
    tau, shells = M.kendall_tau_b(xy).first()[0], M.per_shell(xy)
    ci = M.bootstrap(xy.select("x", "y"), lambda d: d["x"].rank().corr(d["y"].rank()), min(cfg.n_boot, 1000), seed).first()
    scores = {"rho": M.spearman(xy).first()[0], "tau_b": tau, "somers_d": M.somers_d(xy).first()[0], "tie_frac": tie, "tau_b_max": best, "tau_b_ratio": tau / best if best else None, "h_star": M.h_star(shells).first()[0], "rho_low": ci.low, "rho_high": ci.high, "shells": {str(r.h): r.rho_cum for r in shells.collect()}}
    return TaskResult("dist_rank", asdict(cfg), scores, {"pairs": xy.count()})


@register("dist_stress")
def dist_stress(edges: DataFrame, z: DataFrame, cfg: P.Stress, seed: int, strict: bool) -> TaskResult:
    ranking = P.Ranking(cfg.n_pairs, cfg.n_sources)
    xy = _distances_and_hops(edges, z, ranking, seed)
    s = M.stress1(xy).first()
    return TaskResult("dist_stress", asdict(cfg), s.asDict() | {"distortion": M.distortion(xy, s.scale).first().asDict()} | M.isotonic_fit(xy, tol=cfg.tol), {"pairs": xy.count(), "shepard": M.shepard_pairs(xy, cfg.n_keep).count()})


@register("retrieval")
def retrieval(edges: DataFrame, z: DataFrame, cfg: P.Retrieval, seed: int, strict: bool) -> TaskResult:
    near = cut(B.knn(z, cfg.k, cfg.metric), "near")
    return TaskResult("retrieval", asdict(cfg), M.retrieval(near, edges, cfg.k).first().asDict() | {"micro_recall": M.recall_at(near, edges, cfg.k).first()[0]})


@register("link_rank")
def link_rank(edges: DataFrame, z: DataFrame, cfg: P.LinkRank, seed: int, strict: bool) -> TaskResult:
    pairs = cut(link_pairs(edges, P.LinkPrediction(cfg.max_pairs, neg_ratio=cfg.neg_ratio), seed), "pairs")
    s = cut(V.distance(pairs, z, cfg.metric).select("y", (-F.col("dist")).alias("score")), "scored")
    auc = M.classify_scores(s.select("y", F.lit(1).alias("pred"), F.col("score").alias("prob"))).first().auc
    return TaskResult("link_rank", asdict(cfg), {"auc": auc, "ap": M.average_precision(s).first()[0]})


@register("structure")
def structure(edges: DataFrame, z: DataFrame, cfg: P.Structure, seed: int, strict: bool) -> TaskResult:
    labels = cut(G.label_propagation(edges, cfg.rounds, seed), "labels")
    k = max(2, labels.select("label").distinct().count())
    both = cut(kmeans_labels(z, k, seed).join(labels, "id"), "both")
    d = z.select(F.size("vec")).first()[0]
    centre = [float(x) for x in z.agg(*[F.avg(F.col("vec")[i]) for i in range(d)]).first()]
    spread = z.select("id", F.sqrt(F.aggregate(F.zip_with("vec", F.array(*[F.lit(c) for c in centre]), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, x: s + x)).alias("x"))
    by_degree = spread.join(G.degrees(edges).select("id", F.col("deg").cast("double").alias("y")), "id")
    by_rank = spread.join(G.pagerank(edges, cfg.damping).select("id", F.col("rank").alias("y")), "id")
    c = G.conductance(edges, labels).agg(F.avg("conductance")).first()[0]
    return TaskResult("structure", asdict(cfg), {"nmi": M.nmi(both, "label", "cluster").first()[0], "ari": M.ari(both, "label", "cluster").first()[0], "conductance": c, "rho_degree": M.spearman(by_degree).first()[0], "rho_pagerank": M.spearman(by_rank).first()[0]})


def kmeans_labels(z: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """id, cluster."""
    from pyspark.ml.clustering import KMeans

    v = z.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(v).transform(v).select("id", F.col("prediction").cast("long").alias("cluster"))


def stability(zs: list[DataFrame], d: int, k: int = 10) -> dict:
    """Mean over pairs of embeddings of the distance after alignment and of the overlap of neighbours."""
    rms, over = [], []
    near = [cut(B.knn(z, k), "near") for z in zs]
    for i in range(len(zs)):
        for j in range(i):
            rms.append(M.procrustes_rms(zs[i], zs[j], d))
            over.append(M.knn_overlap(near[i], near[j]).first()[0])
    return {"procrustes_rms": float(np.mean(rms)), "knn_jaccard": float(np.mean(over))}


def evaluate(spark: SparkSession, graph, embedding, tasks: tuple[str, ...] = ("link_prediction",), protocol: str = "default", seed: int = 42, tags: dict | None = None, strict: bool = True, **kw) -> Report:
    """Load once, route each setting to the tasks that know it (one nobody knows raises), run, report."""
    known = set().union(*(keywords(t) for t in tasks)) if tasks else set()
    if bad := sorted(set(kw) - known):
        raise TypeError(f"unknown settings {', '.join(bad)}")
    edges, facts = graph if isinstance(graph, tuple) else load_graph(spark, graph)
    edges = cut(edges, "edges")
    z, about = embedding if isinstance(embedding, tuple) else load_embedding(spark, embedding, None if isinstance(embedding, DataFrame) else G.nodes_of(edges))
    z = cut(z.select("id", F.col("vec").cast("array<double>").alias("vec")), "z")
    results, modified = [], False
    for t in tasks:
        if t not in TASKS:
            raise KeyError(f"unknown task {t!r}; there are {', '.join(TASKS)}")
        cfg, changed = P.override(getattr(P.protocol(protocol), t), **{k: v for k, v in kw.items() if k in keywords(t)})
        began = time.time()
        r = TASKS[t](edges, z, cfg, seed, strict)
        r.seconds, modified = time.time() - began, modified or changed
        results.append(r)
    return Report(facts, about, results, protocol, modified, seed, tags or {})


def multi_seed(run: Callable[[int], dict], seeds: list[int]) -> dict[str, dict[str, float]]:
    """mean, std and spread of each score over the seeds."""
    rows = [run(s) for s in seeds]
    return {k: {"mean": float(np.mean(v)), "std": float(np.std(v)), "spread": float(max(v) - min(v))} for k in rows[0] if (v := [r[k] for r in rows])}
