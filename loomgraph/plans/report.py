"""Records of what was measured, their table and their files; the context of a run."""

from __future__ import annotations

import json
import math
import platform
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import UTC, datetime
from typing import Any

SCHEMA = "report/1"


def to_jsonable(x: Any) -> Any:
    if is_dataclass(x) and not isinstance(x, type):
        return to_jsonable(asdict(x))
    if isinstance(x, dict):
        return {str(k): to_jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [to_jsonable(v) for v in x]
    if hasattr(x, "tolist"):
        return to_jsonable(x.tolist())
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def now_iso() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def env() -> dict[str, str]:
    import numpy
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}


def flatten(scores: dict, prefix: str = "") -> dict[str, Any]:
    """Nested scores with dotted names."""
    out: dict[str, Any] = {}
    for k, v in scores.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def fmt(v: Any) -> str:
    return "-" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.4f}" if isinstance(v, float) else str(v)


@dataclass
class TaskResult:
    task: str
    cfg: dict
    scores: dict
    sizes: dict = field(default_factory=dict)
    seconds: float = 0.0
    warnings: list[str] = field(default_factory=list)


@dataclass
class Report:
    graph: dict
    embedding: dict
    results: list[TaskResult]
    protocol: str = "default"
    modified: bool = False
    seed: int = 42
    tags: dict = field(default_factory=dict)
    stamp: str = field(default_factory=now_iso)
    schema: str = SCHEMA

    def record(self) -> dict:
        return to_jsonable(self) | {"env": env()}

    def table(self) -> str:
        """A line a score; a star marks a protocol that was changed."""
        head = f"{self.protocol}{'*' if self.modified else ''}"
        return "\n".join(f"{head} | {r.task} | {k} | {fmt(v)}" for r in self.results for k, v in flatten(r.scores).items())

    def write(self, path: str) -> None:
        """.json holds one record, .jsonl gets a line more; other endings raise."""
        if path.endswith(".json"):
            with open(path, "w") as f:
                json.dump(self.record(), f, indent=1)
        elif path.endswith(".jsonl"):
            with open(path, "a") as f:
                f.write(json.dumps(self.record()) + "\n")
        else:
            raise ValueError("a report is written to .json or .jsonl")


# context of a training run
GAIN = {"plain": lambda b: 1.0, "momentum": lambda b: 1 / (1 - b), "nesterov": lambda b: 1 / (1 - b), "velocity": lambda b: 1.0, "sgd": lambda b: 0.5, "adam": lambda b: None, "swing": lambda b: None, "lbfgs": lambda b: None}
#: The span of dimensions that suits a graph of each class.
REGIMES = {"H": (16, 128), "S": (2, 32)}


@dataclass
class Context:
    method: str = ""
    rule: str = "plain"
    lr: float | None = None
    beta: float = 0.9
    n_dim: int | None = None
    epochs: int | None = None
    seed: int | None = None
    notes: str = ""


def regime(n_dim: int | None, cls: str | None) -> str | None:
    if n_dim is None or cls not in REGIMES:
        return None
    low, high = REGIMES[cls]
    return "low" if n_dim < low else "high" if n_dim > high else "fit"


def validate(ctx: Context, n_dim: int, cls: str | None = None) -> dict:
    """Derived facts and warnings: the effective rate is the rate times the rule's gain on a steady force."""
    if ctx.n_dim is not None and ctx.n_dim != n_dim:
        raise ValueError(f"the context says {ctx.n_dim} dimensions, the embedding has {n_dim}")
    gain = GAIN.get(ctx.rule, lambda b: None)(ctx.beta)
    rate = ctx.lr * gain if ctx.lr is not None and gain is not None else None
    warnings = [f"the effective rate is {rate:.3g}"] if rate is not None and rate >= 1 else []
    return {"gain": gain, "effective_lr": rate, "regime": regime(n_dim, cls), "missing": [k for k in ("lr", "epochs", "seed") if getattr(ctx, k) is None], "warnings": warnings}


def parse_value(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "none": None}.get(text.lower(), text)


def parse_call(text: str) -> tuple[str, dict]:
    """``name`` or ``name(key=value, ...)``."""
    name, call, rest = text.strip().partition("(")
    if not name.isidentifier() or call and not rest.endswith(")"):
        raise ValueError(f"not a task: {text!r}")
    kw = {}
    for part in filter(None, (p.strip() for p in rest[:-1].split(","))):
        k, eq, v = part.partition("=")
        if not eq or not k.strip().isidentifier():
            raise ValueError(f"not a setting: {part!r}")
        kw[k.strip()] = parse_value(v.strip())
    return name, kw


def tags(pairs: list[str]) -> dict:
    out = {}
    for p in pairs:
        k, eq, v = p.partition("=")
        if not eq:
            raise ValueError(f"not a tag: {p!r}")
        out[k] = v
    return out
