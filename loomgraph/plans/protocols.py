"""Named measuring protocols and the settings of each task."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

# The protocols' numbers.
NOISE_FLOOR = 0.015
H_STAR_TOL = 0.02
N_BOOT = 1000


@dataclass(frozen=True)
class LinkPrediction:
    max_pairs: int = 50_000
    test_size: float = 0.2
    neg_ratio: float = 1.0
    feature: str = "hadamard"
    model: str = "rf"
    n_estimators: int = 200
    pos_draw: str = "over_cap"
    neg_draw: str = "reject"


@dataclass(frozen=True)
class DistanceApproximation:
    n_pairs: int = 20_000
    n_sources: int = 0
    min_hop: int = 2
    pair_draw: str = "reject"
    hops: str = "auto"
    feature: str = "distance"
    metric: str = "euclidean"
    models: tuple[str, ...] = ("baseline", "rf", "mlp")
    n_estimators: int = 100
    min_leaf: int = 25
    hidden: tuple[int, ...] = (64, 32)
    early_stopping: bool = True
    test_size: float = 0.2


@dataclass(frozen=True)
class Ranking:
    n_pairs: int = 20_000
    n_sources: int = 200
    min_hop: int = 1
    pair_draw: str = "bfs_rows"
    n_boot: int = N_BOOT
    cross_component: str = "drop"


@dataclass(frozen=True)
class Stress:
    n_pairs: int = 20_000
    n_sources: int = 200
    n_keep: int = 5000
    tol: float = H_STAR_TOL


@dataclass(frozen=True)
class Retrieval:
    k: int = 10
    metric: str = "euclidean"
    by_degree: bool = False
    max_k: int = 100


@dataclass(frozen=True)
class LinkRank:
    max_pairs: int = 50_000
    neg_ratio: float = 1.0
    metric: str = "euclidean"


@dataclass(frozen=True)
class Structure:
    rounds: int = 10
    damping: float = 0.85


@dataclass(frozen=True)
class Stability:
    k: int = 10


@dataclass(frozen=True)
class Protocol:
    link_prediction: LinkPrediction = field(default_factory=LinkPrediction)
    dist_approx: DistanceApproximation = field(default_factory=DistanceApproximation)
    dist_rank: Ranking = field(default_factory=Ranking)
    dist_stress: Stress = field(default_factory=Stress)
    retrieval: Retrieval = field(default_factory=Retrieval)
    link_rank: LinkRank = field(default_factory=LinkRank)
    structure: Structure = field(default_factory=Structure)
    stability: Stability = field(default_factory=Stability)


PROTOCOLS = {
    "default": Protocol(),
    "other": Protocol(LinkPrediction(80_000, n_estimators=100)),
    "large": Protocol(LinkPrediction(80_000, n_estimators=100, pos_draw="always"), DistanceApproximation(n_sources=200, hops="bfs")),
    "citation": Protocol(LinkPrediction(neg_draw="far_pairs"), DistanceApproximation(2_000, n_estimators=200, min_leaf=1, hidden=(128, 64))),
    "shell_distance": Protocol(LinkPrediction(neg_draw="far_pairs"), DistanceApproximation(n_sources=200, pair_draw="bfs_rows", hops="bfs", min_leaf=1, hidden=(256, 128), early_stopping=False)),
    "shell_vector": Protocol(LinkPrediction(neg_draw="far_pairs"), DistanceApproximation(n_sources=200, pair_draw="bfs_rows", hops="bfs", feature="vector", min_leaf=1, hidden=(256, 128), early_stopping=False)),
    "measure_quick": Protocol(dist_rank=Ranking(2_000, 50), dist_stress=Stress(2_000, 50)),
    "measure_hops": Protocol(dist_rank=Ranking(pair_draw="stratified_by_hop")),
    "measure_sources": Protocol(dist_rank=Ranking(n_sources=500)),
}


def protocol(name: str) -> Protocol:
    if name not in PROTOCOLS:
        raise KeyError(f"unknown protocol {name!r}; there are {', '.join(PROTOCOLS)}")
    return PROTOCOLS[name]


def get(name: str) -> tuple[LinkPrediction, DistanceApproximation]:
    p = protocol(name)
    return p.link_prediction, p.dist_approx


def override(cfg, **kw):
    """cfg with what isn't None replaced, and whether anything was given; an unknown name raises."""
    known = {f.name for f in fields(cfg)}
    if bad := sorted(set(kw) - known):
        raise TypeError(f"unknown settings {', '.join(bad)}")
    given = {k: v for k, v in kw.items() if v is not None}
    return replace(cfg, **given), bool(given)


@dataclass(frozen=True)
class Floor:
    """Differences below are noise, relative to the value."""

    accuracy: float = NOISE_FLOOR
    auc: float = NOISE_FLOOR
    rho: float = NOISE_FLOOR
    recall: float = NOISE_FLOOR
    nmi: float = NOISE_FLOOR

    def of(self, metric: str, value: float) -> float:
        return abs(value) * getattr(self, metric, NOISE_FLOOR)


def compare(a: list[float], b: list[float], floor: float) -> str:
    """WIN, LOSS, TIE (within the floor) or MEASUREMENT (within the spread of the seeds) of a against b."""
    mean = lambda v: sum(v) / len(v)
    d, spread = mean(a) - mean(b), max(max(a) - min(a), max(b) - min(b))
    if abs(d) <= floor:
        return "TIE"
    if abs(d) <= spread:
        return "MEASUREMENT"
    return "WIN" if d > 0 else "LOSS"
