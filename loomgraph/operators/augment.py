"""From a graph to its pair table: the three policies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import cut
from . import pairs as P
from .graph import id_map, nodes_of
from .paths import landmark_table, pick_landmarks
from .walks import starts_of, walker


@dataclass(frozen=True)
class AugmentSpec:
    """All settings of the augmentation; an unknown name raises."""

    pairs: str = "walk"
    edge_rule: str = "both"
    policy: str = "cap"
    walks: int = 10
    walk_len: int = 20
    window: int = 5
    cap: int = 16
    row_cap: int = 0
    p: float = 1.0
    q: float = 1.0
    weight: str = "min_gap"
    freq_mode: str = "pair"
    far: int = 0
    far_weight: float = 100.0
    far_bias: float = 0.0
    landmarks: int = 0
    far_max: int = 32
    far_scale: float = 1.0
    buckets: bool = False
    neighbours: str = "all"
    total: int = 0
    seed: int = 42

    @classmethod
    def of(cls, **kw) -> AugmentSpec:
        known = {f.name for f in fields(cls)}
        if bad := sorted(set(kw) - known):
            raise TypeError(f"unknown settings {', '.join(bad)}")
        return replace(cls(), **kw)


class Augmentation(NamedTuple):
    table: DataFrame  # u, v, h, freq
    stats: DataFrame
    info: dict


def _walk_stats(edges: DataFrame, spec: AugmentSpec) -> DataFrame:
    walk = walker(edges, spec.p, spec.q)
    return P.pair_stats(walk(starts_of(nodes_of(edges), spec.walks), spec.walk_len, spec.seed), spec.window)


def _far(edges: DataFrame, spec: AugmentSpec, near: DataFrame, count: int, directed: bool) -> DataFrame:
    nodes = id_map(edges).select(F.col("raw").alias("id"), F.col("id").alias("rank"))
    table = P.degree_table(edges, spec.far_bias) if spec.far_bias else None
    far = P.sample_far_pairs(cut(nodes, "nodes"), count, near, spec.seed, cumulative=table, directed=directed)
    if spec.landmarks:
        return P.landmark_far_weight(far, landmark_table(edges, pick_landmarks(edges, spec.landmarks, spec.seed)), spec.far_max, spec.far_scale, spec.far_weight)
    return P.constant_far_weight(far, spec.far_weight)


def walk_policy(edges: DataFrame, spec: AugmentSpec, with_edges: bool = False) -> Augmentation:
    """Walk statistics -> cap or strata -> weight (-> missing edges) -> far pairs."""
    stats = cut(_walk_stats(edges, spec), "stats")
    kept = stats if spec.policy == "buckets" else P.cap_per_node(stats, spec.cap)
    weighed = P.WEIGHTS[spec.weight](kept, spec.window)
    n = nodes_of(edges).count()
    if spec.policy == "buckets":
        total = spec.total or P.budget(n)
        high = P.bucket_sample(weighed.where("h >= 2"), total, spec.seed)
        e = edges.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
        known = e.join(weighed.select("u", "v", "cnt"), ["u", "v"], "left")
        base = high.join(e, ["u", "v"], "left_anti").select("u", "v", "h", F.col("cnt").cast("double").alias("freq"))
        pairs = base.union(known.select("u", "v", F.lit(1.0).alias("h"), F.coalesce("cnt", F.lit(1)).cast("double").alias("freq")))
        count = spec.far
    else:
        if with_edges:
            missing = P.add_missing_edges(weighed.select("u", "v", "mn", "sm", "cnt"), edges).join(weighed.select("u", "v"), ["u", "v"], "left_anti")
            weighed = weighed.select("u", "v", "h", "cnt").union(missing.select("u", "v", F.col("mn").cast("double").alias("h"), "cnt"))
        pairs = weighed.select("u", "v", "h", F.col("cnt").cast("double").alias("freq"))
        count = spec.far or P.budget(n)
    pairs = cut(pairs, "pairs")
    table = P.both_ways(pairs)
    if count:
        table = P.add_far_pairs(table, _far(edges, spec, pairs, count, False))
    table = cut(table, "table")
    return Augmentation(table, stats, {"n": n, "nnz": table.count(), "found": stats.count(), "kept": pairs.count(), "prunes": 0})


def walk_edges_policy(edges: DataFrame, spec: AugmentSpec) -> Augmentation:
    return walk_policy(edges, spec, with_edges=True)


def nbr_walk_policy(edges: DataFrame, spec: AugmentSpec) -> Augmentation:
    """Rows of walks from each node -> row cap -> neighbours -> strata (if asked for) -> frequency -> far pairs (if asked for)."""
    walk = walker(edges, spec.p, spec.q)
    stats = cut(P.row_stats(walk(starts_of(nodes_of(edges), spec.walks), spec.walk_len, spec.seed)), "stats")
    rows = P.row_cap(stats, spec.row_cap)
    rows = {"all": P.with_all_neighbours, "low_deg": P.with_low_degree_neighbours}[spec.neighbours](rows, edges)
    n = nodes_of(edges).count()
    if spec.buckets:
        rows = P.row_buckets(rows, n, spec.total or None, spec.seed)
    rows = {"pair": P.freq_pair, "node": P.freq_node}[spec.freq_mode](rows)
    table = rows.select("u", "v", F.col("mn").cast("double").alias("h"), "freq")
    if spec.far:
        table = cut(table, "table")
        table = P.add_far_pairs(table, _far(edges, spec, table, spec.far, True))
    table = cut(table, "table")
    return Augmentation(table, stats, {"n": n, "nnz": table.count(), "found": stats.count(), "prunes": 0})


POLICIES: dict[str, Callable] = {"walk": walk_policy, "walk_edges": walk_edges_policy, "nbr_walk": nbr_walk_policy}


def augment(edges: DataFrame, spec: AugmentSpec | None = None, table: DataFrame | None = None, **kw) -> Augmentation:
    """Build the pair table, or take one that was stored."""
    spec = spec or AugmentSpec.of(**kw)
    if table is not None:
        return Augmentation(table, table, {"nnz": table.count()})
    if spec.pairs not in POLICIES:
        raise KeyError(f"unknown policy {spec.pairs!r}; there are {', '.join(POLICIES)}")
    return POLICIES[spec.pairs](edges, spec)
