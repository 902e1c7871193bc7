"""Update rules.  State lies beside the vector as array columns; t is the number of the step, from 1.

Each rule takes the columns (z, g, state...) and gives the new vector and state.  All are row-local but L-BFGS, whose
dot products are sums over all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import u01
from ..plans.state import cut


def _add(a: Column, b: Column, k: float | Column = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * k)


def _scale(a: Column, k: float | Column) -> Column:
    return F.transform(a, lambda x: x * k)


def plain(z, g, s, lr, t, id, **kw):
    return _add(z, g, lr), {}


def momentum(z, g, s, lr, t, id, beta: float = 0.9, **kw):
    m = F.when(s["m"].isNull(), g).otherwise(F.zip_with(s["m"], g, lambda a, b: beta * a + b))
    return _add(z, m, lr), {"m": m}


def nesterov(z, g, s, lr, t, id, beta: float = 0.9, **kw):
    m = F.when(s["m"].isNull(), g).otherwise(F.zip_with(s["m"], g, lambda a, b: beta * a + b))
    return _add(z, _add(g, m, beta), lr), {"m": m}


def adam(z, g, s, lr, t, id, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, **kw):
    zero = _scale(g, 0.0)
    m = F.zip_with(F.coalesce(s["m"], zero), g, lambda a, b: b1 * a + (1 - b1) * b)
    v = F.zip_with(F.coalesce(s["v"], zero), g, lambda a, b: b2 * a + (1 - b2) * b * b)
    step = F.zip_with(m, v, lambda a, b: (a / (1 - b1**t)) / (F.sqrt(b / (1 - b2**t)) + eps))
    return _add(z, step, lr), {"m": m, "v": v}


def swing(z, g, s, lr, t, id, k_s: float = 0.1, k_max: float = 10.0, **kw):
    """A row's speed falls where its force swings and rises where it pulls; the first step is plain."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    sw = norm(F.zip_with(g, s["m"], lambda a, b: a - b))
    tract = norm(F.zip_with(g, s["m"], lambda a, b: a + b)) / 2
    speed = F.when(s["m"].isNull(), 1.0).otherwise(F.least(k_s * tract / (1 + F.sqrt(sw)), F.lit(k_max)))
    return _add(z, g, lr * speed), {"m": g}


def velocity(z, g, s, lr, t, id, eta: float = 0.3, **kw):
    """A moving average of the force; it begins with the first force a row meets, not with zero."""
    v = F.when(s["m"].isNull(), g).otherwise(F.zip_with(s["m"], g, lambda a, b: eta * b + (1 - eta) * a))
    return _add(z, v, lr), {"m": v}


def sgd(z, g, s, lr, t, id, frac: float = 0.5, seed: int = 0, **kw):
    """Rows move with probability frac."""
    return F.when(u01("sgd", t, id, seed=seed) < frac, _add(z, g, lr)).otherwise(z), {}


@dataclass(frozen=True)
class Rule:
    step: Callable
    state: tuple[str, ...]


RULES = {"plain": Rule(plain, ()), "momentum": Rule(momentum, ("m",)), "nesterov": Rule(nesterov, ("m",)), "adam": Rule(adam, ("m", "v")), "swing": Rule(swing, ("m",)), "velocity": Rule(velocity, ("m",)), "sgd": Rule(sgd, ())}


def rule(name: str) -> Rule:
    if name not in RULES:
        raise KeyError(f"unknown rule {name!r}; there are {', '.join(sorted([*RULES, 'lbfgs']))}")
    return RULES[name]


def state_arrays(name: str, memory: int = 3) -> int:
    """How many vectors a row keeps beside its own."""
    return 2 * memory + 2 if name == "lbfgs" else len(rule(name).state)


def start_state(z: DataFrame, name: str) -> DataFrame:
    """State that is null until a row's first step: rows of later batches meet the rule's first-step form when they come."""
    return z.select("id", "vec", *[F.lit(None).cast("array<double>").alias(s) for s in rule(name).state])


def apply(z: DataFrame, force: DataFrame, name: str, lr: float, t: int, **kw) -> DataFrame:
    """z(id, vec, state...) moved by force(id, g); rows without a force get 0."""
    r = rule(name)
    j = z.join(force, "id", "left").withColumn("g", F.coalesce("g", _scale(F.col("vec"), 0.0)))
    vec, state = r.step(F.col("vec"), F.col("g"), {s: F.col(s) for s in r.state}, lr, t, F.col("id"), **kw)
    return j.select("id", vec.alias("vec"), *[state[s].alias(s) for s in r.state])


class LBFGS:
    """Two-loop recursion over the last ``memory`` steps; curvature pairs with s.y <= eps are left out."""

    def __init__(self, memory: int = 3, eps: float = 1e-10) -> None:
        self.memory, self.eps, self.pairs, self.last = memory, eps, [], None

    @staticmethod
    def _dot(a: DataFrame, b: DataFrame) -> float:
        both = a.join(b.withColumnRenamed("vec", "w"), "id")
        return both.agg(F.sum(F.aggregate(F.zip_with("vec", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))).first()[0] or 0.0

    @staticmethod
    def _plus(a: DataFrame, b: DataFrame, k: float) -> DataFrame:
        return a.join(b.withColumnRenamed("vec", "w"), "id").select("id", F.zip_with("vec", "w", lambda x, y: x + k * y).alias("vec"))

    def step(self, z: DataFrame, force: DataFrame, lr: float) -> DataFrame:
        g = force.select("id", F.transform("g", lambda x: -x).alias("vec"))  # the gradient is against the force
        if self.last is not None:
            s, y = cut(self._plus(z, self.last[0], -1.0)), cut(self._plus(g, self.last[1], -1.0))
            sy = self._dot(s, y)
            if sy > self.eps:
                self.pairs = [*self.pairs, (s, y, sy)][-self.memory :]
        self.last = (z, g)
        d, alphas = g, []
        for s, y, sy in reversed(self.pairs):
            a = self._dot(s, d) / sy
            alphas.append(a)
            d = cut(self._plus(d, y, -a))
        if self.pairs:
            s, y, sy = self.pairs[-1]
            k = sy / max(self._dot(y, y), self.eps)
            d = d.select("id", F.transform("vec", lambda x: x * k).alias("vec"))
        for (s, y, sy), a in zip(self.pairs, reversed(alphas), strict=True):
            d = cut(self._plus(d, s, a - self._dot(y, d) / sy))
        return cut(self._plus(z, d, -lr))
