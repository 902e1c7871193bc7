"""Distances and pair features of two vector columns (ARRAY<DOUBLE>), by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product: a similarity, greater is nearer."""
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm2(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x * x))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared(a, b))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; the denominator has a floor, so a zero vector is at distance 1."""
    return 1.0 - dot(a, b) / F.greatest(F.sqrt(norm2(a)) * F.sqrt(norm2(b)), F.lit(1e-12))


def poincare(a: Column, b: Column) -> Column:
    """Hyperbolic distance in the unit ball."""
    room = F.greatest((1.0 - norm2(a)) * (1.0 - norm2(b)), F.lit(1e-12))
    return F.acosh(F.greatest(1.0 + 2.0 * squared(a, b) / room, F.lit(1.0 + 1e-12)))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def l1(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def average(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2.0)


def joined(a: Column, b: Column) -> Column:
    return F.concat(a, b)


DISTANCES: dict[str, Callable] = {"euclidean": euclidean, "poincare": poincare, "cosine": cosine, "dot": dot}
FEATURES: dict[str, Callable] = {"hadamard": hadamard, "l1": l1, "concat": joined, "avg": average}


def pick(table: dict[str, Callable], name: str, what: str) -> Callable:
    if name not in table:
        raise KeyError(f"unknown {what} {name!r}; there are {', '.join(sorted(table))}")
    return table[name]


def with_ends(pairs, z, a: str = "zu", b: str = "zv"):
    """pairs(u, v, ...) with the vectors of both ends; z(id, vec)."""
    zu = z.select(F.col("id").alias("u"), F.col("vec").cast("array<double>").alias(a))
    zv = z.select(F.col("id").alias("v"), F.col("vec").cast("array<double>").alias(b))
    return pairs.join(zu, "u").join(zv, "v")


def distance(pairs, z, metric: str = "euclidean"):
    """Adds ``dist``."""
    f = pick(DISTANCES, metric, "metric")
    return with_ends(pairs, z).withColumn("dist", f(F.col("zu"), F.col("zv"))).drop("zu", "zv")


def feature(pairs, z, kind: str = "hadamard"):
    """Adds ``feature``."""
    f = pick(FEATURES, kind, "feature")
    return with_ends(pairs, z).withColumn("feature", f(F.col("zu"), F.col("zv"))).drop("zu", "zv")
