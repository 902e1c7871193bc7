"""Force laws: the size of the force on u along u -> v for a stored pair, from its distance x, hop h and frequency.

Each law is a column expression over x, h, freq, w, deg_le, shell_c and ends divided by the degree (where above 0).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAMS = {"k1": 0.999, "k2": 1.0, "k3": 10.0, "k4": 0.01, "kr": 1.0, "sign": -1.0, "h_shift": 0.0}


def _x() -> Column:
    return F.col("x")


def _h() -> Column:
    return F.col("h")


def _near(a: Column, b: Column) -> Column:
    return F.when(_h() <= 1, a).otherwise(b)


def linear(p: dict) -> Column:
    e = F.exp(p["sign"] * p["k4"] * _x())
    return _near(p["k1"] * _x() - p["kr"] * e, -(_h() / F.greatest(F.col("freq"), F.lit(1.0))) * e)


def linear_fused(p: dict) -> Column:
    """The same from one plane: -1 near, h / freq far, 0 nothing."""
    e = F.exp(p["sign"] * p["k4"] * _x())
    w = F.col("w")
    return F.when(w < 0, p["k1"] * _x() - p["kr"] * e).otherwise(-w * e)


def hop(p: dict) -> Column:
    return _near(p["k1"] * _x() - p["kr"] * _h(), -p["kr"] * _h() * F.exp(-p["k4"] * _x()))


def hop2(p: dict) -> Column:
    r = p["kr"] * _h() * F.exp(-p["k4"] * _x())
    return _near(p["k1"] * _x() - r, -r)


def hop_min(p: dict) -> Column:
    """Near pairs act only on the end of lower degree."""
    return _near(F.when(F.col("deg_le") > 0, p["k1"] * _x() - p["kr"] * _h()).otherwise(0.0), -p["kr"] * _h() * F.exp(-p["k4"] * _x()))


def hop_all(p: dict) -> Column:
    return p["k1"] * _x() * F.exp(-p["k2"] * _h()) - p["kr"] * _h() * F.exp(-p["k4"] * _x())


def hop_all_freq(p: dict) -> Column:
    return F.col("freq") * hop_all(p)


def shell(p: dict) -> Column:
    """Attraction averaged over the nodes at the same distance."""
    return p["k1"] * F.col("shell_c") * _x() * F.exp(-p["k2"] * (_h() - p["h_shift"])) - p["k3"] * _h() * F.exp(-p["k4"] * _x())


def shell_v2(p: dict) -> Column:
    """Attraction near, a constant push beyond."""
    return _near(p["k1"] * F.col("shell_c") * _x() * F.exp(-p["k2"] * (_h() - p["h_shift"])), -p["k3"] * _h())


def edge_constants(p: dict) -> Column:
    """Two constants an edge: c1 * x - c2 * exp(-x)."""
    return F.col("c1") * _x() - F.col("c2") * F.exp(-_x())


@dataclass(frozen=True)
class Law:
    expr: Callable[[dict], Column]
    planes: tuple[str, ...]
    divide: bool = True


LAWS = {
    "linear": Law(linear, ("h", "freq")), "linear_fused": Law(linear_fused, ("w",)), "hop": Law(hop, ("h",)), "hop2": Law(hop2, ("h",)),
    "hop_min": Law(hop_min, ("h", "deg_le")), "hop_all": Law(hop_all, ("h",)), "hop_all_freq": Law(hop_all_freq, ("h", "freq")),
    "shell": Law(shell, ("h", "shell_c")), "shell_v2": Law(shell_v2, ("h", "shell_c")), "linear_undivided": Law(linear, ("h", "freq"), False), "edge_constants": Law(edge_constants, ("c1", "c2")),
}


def law(name: str) -> Law:
    if name not in LAWS:
        raise KeyError(f"unknown law {name!r}; there are {', '.join(sorted(LAWS))}")
    return LAWS[name]


def planes_of(name: str) -> tuple[str, ...]:
    return law(name).planes


def fuse() -> Column:
    return F.when(_h() <= 1, F.lit(-1.0)).otherwise(_h() / F.greatest(F.col("freq"), F.lit(1.0)))


def near_degrees(table: DataFrame) -> DataFrame:
    """id, degree: how many pairs at h = 1 a row stores."""
    return table.groupBy(F.col("u").alias("id")).agg(F.sum((F.col("h") == 1).cast("long")).cast("double").alias("degree"))


def resolve_degrees(table: DataFrame, edges: DataFrame | None = None, source: str = "pairs", explicit: DataFrame | None = None) -> DataFrame:
    """id, degree: ``one`` (no averaging), ``graph`` (at least 1), ``pairs`` (stored h = 1), or the table given."""
    if explicit is not None:
        return explicit
    if source == "one":
        return table.select(F.col("u").alias("id")).distinct().withColumn("degree", F.lit(1.0))
    if source == "graph":
        from .graph import degrees

        d = degrees(edges).select("id", F.greatest("deg", F.lit(1)).cast("double").alias("degree"))
        return table.select(F.col("u").alias("id")).distinct().join(d, "id", "left").select("id", F.coalesce("degree", F.lit(1.0)).alias("degree"))
    return near_degrees(table)


def shell_coefficient(table: DataFrame) -> DataFrame:
    """Adds shell_c = 1 / how many nodes lie at that distance from u; an aggregate and a join, so hubs spread."""
    n = table.groupBy("u", "h").agg(F.count(F.lit(1)).alias("n_shell"))
    return table.join(n, ["u", "h"]).withColumn("shell_c", 1.0 / F.col("n_shell")).drop("n_shell")


def weighted_shell_coefficient(hops: DataFrame, weighted: DataFrame) -> DataFrame:
    """Shells by hop count, h by weighted distance."""
    return shell_coefficient(hops).select("u", "v", "shell_c").join(weighted.select("u", "v", "h"), ["u", "v"])


def degree_order(table: DataFrame) -> DataFrame:
    """Adds deg_le: 1 where u's stored degree is at most v's, else -1."""
    d = near_degrees(table)
    both = table.join(d.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v", "left")
    return both.withColumn("deg_le", F.when(F.col("du") <= F.coalesce("dv", F.lit(0.0)), 1).otherwise(-1)).drop("du", "dv")


def build_planes(name: str, table: DataFrame) -> DataFrame:
    """The columns a law needs; one that can't be made raises."""
    for plane in planes_of(name):
        if plane in table.columns:
            continue
        if plane == "w" and "freq" in table.columns:
            table = table.withColumn("w", fuse())
        elif plane == "deg_le":
            table = degree_order(table)
        elif plane == "shell_c":
            table = shell_coefficient(table)
        else:
            raise ValueError(f"law {name!r} needs the column {plane!r}")
    return table


def violations(name: str, table: DataFrame, degrees: DataFrame) -> DataFrame:
    """One row of counts of what must not be: counted in one pass over the pairs and one join."""
    bad = {"h": (F.col("h") < 1) | (F.col("h") != F.rint("h")), "freq": F.col("freq") < 1, "w": ((F.col("w") < 0) & (F.col("w") != -1)) | (F.col("w") == 0), "deg_le": ~F.col("deg_le").isin(-1, 0, 1), "shell_c": (F.col("shell_c") <= 0) | (F.col("shell_c") > 1)}
    counts = [F.sum(F.coalesce(bad[p], F.lit(True)).cast("long")).alias(f"bad_{p}") for p in planes_of(name) if p in bad]
    rows = table.select("u").distinct().join(degrees.select(F.col("id").alias("u"), "degree"), "u", "left")
    return table.agg(F.count(F.lit(1)).alias("pairs"), *counts).join(F.broadcast(rows.agg(F.sum((F.coalesce("degree", F.lit(0.0)) <= 0).cast("long")).alias("zero_degree"))))  # one row each


def check(name: str, table: DataFrame, degrees: DataFrame) -> None:
    """Raise if the pair table breaks the law's contract."""
    got = {k: v for k, v in violations(name, table, degrees).first().asDict().items() if k != "pairs" and v}
    if got:
        raise ValueError(f"law {name!r}: " + ", ".join(f"{k} {v}" for k, v in got.items()))


def magnitude(name: str, params: dict | None = None) -> Column:
    """The law over x and its planes, divided by the column ``degree`` where that is above 0."""
    chosen = law(name)
    f = chosen.expr(PARAMS | (params or {}))
    return f / F.when(F.col("degree") > 0, F.col("degree")).otherwise(1.0) if chosen.divide else f


def elementwise(pairs: DataFrame) -> DataFrame:
    """Per coordinate: clip(d * x_w * exp(-y_w) - exp(-d), -100, 100) with d the difference of the ends (zu, zv)."""
    f = F.zip_with("zu", "zv", lambda a, b: F.least(F.greatest((b - a) * F.col("x_w") * F.exp(-F.col("y_w")) - F.exp(-(b - a)), F.lit(-100.0)), F.lit(100.0)))
    return pairs.withColumn("f", f)
