"""Pair tables: statistics of walks, merges with edges, caps, strata, far pairs and weights.

Undirected statistics are (u, v, mn, sm, cnt) with u < v; directed ones (u, v, mn, cnt); a finished table is
(u, v, h, freq) with a row for each direction it holds.  An absent pair is an absent row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import SEED, below, key, u01
from ..plans.state import cut

FRACTIONS = (0.5, 0.25, 0.25)


# statistics of walks
def pair_stats(walks: DataFrame, window: int) -> DataFrame:
    """u < v, least gap, sum of gaps, count over all pairs of a walk at most ``window`` steps apart.

    Pairs come from inside each path, so nothing is shuffled before the aggregation.
    """
    at = F.sequence(F.lit(0), F.size("path") - 2)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(window), F.size("path") - 1 - i)), lambda g: F.struct(F.get("path", i).alias("a"), F.get("path", i + g).alias("b"), g.alias("gap")))))
    rows = walks.where(F.size("path") > 1).select(F.inline(pairs)).where("a <> b")
    return rows.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("gap").cast("long").alias("mn"), F.sum("gap").cast("long").alias("sm"), F.count(F.lit(1)).alias("cnt"))


def row_stats(walks: DataFrame) -> DataFrame:
    """u (start), v (visited, other than the start), first step, visits."""
    rows = walks.select(F.col("start").alias("u"), F.posexplode("path").alias("step", "v")).where("step > 0 and u <> v")
    return rows.groupBy("u", "v").agg(F.min("step").cast("long").alias("mn"), F.count(F.lit(1)).alias("cnt"))


def ball_stats(hops: DataFrame, window: int) -> DataFrame:
    """All pairs within some hops (u, v, h) as statistics: the nearer, the more often seen."""
    near = hops.where("u < v")
    return near.select("u", "v", F.col("h").cast("long").alias("mn"), F.col("h").cast("long").alias("sm"), F.greatest(F.lit(window + 1) - F.col("h"), F.lit(1)).cast("long").alias("cnt"))


def rows_of(edges: DataFrame, nodes: DataFrame, walk: Callable, n_walks: int, length: int) -> DataFrame:
    """u, v, h, freq of a batch of rows: fresh walks and all neighbours at 1; nothing is kept."""
    from .walks import starts_of

    stats = row_stats(walk(starts_of(nodes, n_walks), length))
    mine = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return with_all_neighbours(stats, mine).select("u", "v", F.col("mn").cast("double").alias("h"), F.col("cnt").cast("double").alias("freq"))


# merges
def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two directed statistics: least first step, summed counts."""
    return a.select("u", "v", "mn", "cnt").union(b.select("u", "v", "mn", "cnt")).groupBy("u", "v").agg(F.min("mn").alias("mn"), F.sum("cnt").alias("cnt"))


def with_all_neighbours(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge enters at 1, counted once more."""
    return merge(stats, edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).cast("long").alias("mn"), F.lit(1).cast("long").alias("cnt")))


def with_low_degree_neighbours(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """An edge enters row u only where the other end's degree is at least u's."""
    from .graph import degrees

    d = degrees(edges)
    e = edges.join(d.select(F.col("id").alias("src"), F.col("deg").alias("du")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("dv")), "dst")
    return with_all_neighbours(stats, e.where("dv >= du").select("src", "dst"))


def add_missing_edges(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected statistics with the edges the walks missed, at gap 1."""
    one = F.lit(1).cast("long")
    e = edges.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), one.alias("mn"), one.alias("sm"), one.alias("cnt"))
    return stats.union(e.join(stats.select("u", "v"), ["u", "v"], "left_anti"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Undirected (u, v, h, freq) in both directions; what meets at one place is summed."""
    p = pairs.select("u", "v", "h", "freq")
    return p.union(p.select(F.col("v").alias("u"), F.col("u").alias("v"), "h", "freq")).groupBy("u", "v").agg(F.sum("h").alias("h"), F.sum("freq").alias("freq"))


def add_far_pairs(table: DataFrame, far: DataFrame) -> DataFrame:
    """far (u, v, w) enters in both directions with freq 1; what is there already is summed."""
    f = far.select("u", "v", F.col("w").cast("double").alias("h"), F.lit(1.0).alias("freq"))
    rows = table.select("u", "v", "h", "freq").union(f).union(f.select(F.col("v").alias("u"), F.col("u").alias("v"), "h", "freq"))
    return rows.groupBy("u", "v").agg(F.sum("h").alias("h"), F.sum("freq").alias("freq"))


def drop_pairs(far: DataFrame, near: DataFrame) -> DataFrame:
    """far without the pairs near has in either direction."""
    n = near.select("u", "v")
    return far.join(n, ["u", "v"], "left_anti").join(n.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")


def assert_rows_unique(table: DataFrame) -> None:
    """Each (u, v) once, else raise."""
    twice = table.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    if twice:
        raise ValueError(f"pair ({twice[0].u}, {twice[0].v}) is stored {twice[0].n} times")


# caps and strata
def cap_per_node(stats: DataFrame, m: int) -> DataFrame:
    """Keep a pair if either end has it among its m most frequent (ties: u's side first, then u, v); m <= 0 keeps all."""
    if m <= 0:
        return stats
    ends = stats.select(F.col("u").alias("node"), F.lit(0).alias("side"), "u", "v", "cnt").union(stats.select(F.col("v").alias("node"), F.lit(1).alias("side"), "u", "v", "cnt"))
    w = Window.partitionBy("node").orderBy(F.desc("cnt"), "side", "u", "v")
    kept = ends.withColumn("r", F.row_number().over(w)).where(F.col("r") <= m).select("u", "v").distinct()
    return stats.join(kept, ["u", "v"], "left_semi")


def row_cap(stats: DataFrame, m: int) -> DataFrame:
    """The m most frequent of each row, ties by column; m <= 0 keeps all."""
    if m <= 0:
        return stats
    w = Window.partitionBy("u").orderBy(F.desc("cnt"), "v")
    return stats.withColumn("r", F.row_number().over(w)).where(F.col("r") <= m).drop("r")


def budget(n: int) -> int:
    return int(n * math.log10(max(n, 10)))


def _stratum(h: Column) -> Column:
    return F.when(h <= 2, 2).when(h == 3, 3).otherwise(4)


def bucket_sample(pairs: DataFrame, total: int, seed: int = SEED, fractions: tuple[float, ...] = FRACTIONS, h: str = "h") -> DataFrame:
    """A sample without replacement by strata h = 2, 3 and more; a stratum that is short isn't topped up.

    A stratum's cut in the random order is found from counts of leading digits first, so that no task ranks a whole stratum.
    """
    quota = {s: int(round(total * f)) for s, f in zip((2, 3, 4), fractions, strict=True)}
    rows = pairs.withColumn("stratum", _stratum(F.col(h))).withColumn("k", key("bucket", F.col("u"), F.col("v"), seed=seed))
    return _first_by_key(rows, quota, ["u", "v"]).drop("stratum", "k")


def _first_by_key(rows: DataFrame, quota: dict[int, int], ties: list[str]) -> DataFrame:
    """The first quota[stratum] rows of each stratum in the order of k."""
    rows = rows.withColumn("lead", F.substring("k", 1, 3))
    per = rows.groupBy("stratum", "lead").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("stratum").orderBy("lead")) - F.col("n"))
    most = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    per = per.withColumn("quota", F.coalesce(F.element_at(most, F.col("stratum")), F.lit(0))).where("before < quota").select("stratum", "lead", "before", "quota", (F.col("before") + F.col("n") > F.col("quota")).alias("edge"))
    near = rows.join(per, ["stratum", "lead"])
    whole = near.where("not edge")
    w = Window.partitionBy("stratum", "lead").orderBy("k", *ties)
    part = near.where("edge").withColumn("r", F.row_number().over(w)).where("before + r <= quota").drop("r")
    return whole.union(part).drop("lead", "before", "quota", "edge")


def row_buckets(stats: DataFrame, n: int | None = None, total: int | None = None, seed: int = SEED, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """Directed rows: all at h <= 1, and a stratified sample of the rest from one budget for all rows."""
    total = budget(n) if total is None else total
    far = bucket_sample(stats.where("mn > 1"), total, seed, fractions, "mn")
    return stats.where("mn <= 1").unionByName(far)


# far pairs
def degree_table(edges: DataFrame, alpha: float) -> DataFrame:
    """id, low, high: each node's stretch of [0, 1) by max(deg, 1) ** alpha, in the order of ids.

    Sums of id ranges come first, so the running sum of a range needs only the ranges before.
    """
    from .graph import degrees

    w = degrees(edges).select("id", F.pow(F.greatest("deg", F.lit(1)).cast("double"), F.lit(alpha)).alias("w"))
    w = w.withColumn("range", F.floor(F.col("id") / F.lit(4096)))
    per = w.groupBy("range").agg(F.sum("w").alias("s"))
    total = Window.partitionBy(F.lit(0))
    per = per.select("range", (F.sum("s").over(total.orderBy("range")) - F.col("s")).alias("before"), F.sum("s").over(total).alias("all"))
    run = F.sum("w").over(Window.partitionBy("range").orderBy("id"))
    return w.join(per, "range").select("id", ((F.col("before") + run - F.col("w")) / F.col("all")).alias("low"), ((F.col("before") + run) / F.col("all")).alias("high"))


def sample_far_pairs(nodes: DataFrame, count: int, near: DataFrame, seed: int = SEED, max_tries: int = 40, cumulative: DataFrame | None = None, directed: bool = False) -> DataFrame:
    """``count`` different pairs u < v that near doesn't hold; with directed, near counts in either direction.

    Candidates are hashes of their number.  A round draws twice what is missing and 1024 more; rounds end when enough
    are found or after max_tries.  nodes(id, rank) numbers nodes densely (``id_map``); a cumulative table draws by degree.
    """
    n = nodes.count()
    spark = nodes.sparkSession
    known = near.select("u", "v")
    if directed:
        known = known.union(known.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    found, have, start = None, 0, 0
    if n < 2 or count <= 0:
        return spark.createDataFrame([], "u long, v long")
    for _ in range(max_tries):
        room = 2 * (count - have) + 1024
        c = spark.range(start, start + room).withColumnRenamed("id", "i")
        for side in ("a", "b"):
            if cumulative is None:
                ends = nodes.select(F.col("rank").alias(f"r{side}"), F.col("id").alias(side))
                c = c.withColumn(f"r{side}", below(n, "far", F.col("i"), side, seed=seed)).join(ends, f"r{side}")
            else:
                # an inverse-CDF draw as an equi-join: both sides are cut into cells of the unit interval
                cells = 1024
                ends = cumulative.select(F.col("id").alias(side), "low", "high", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))).alias("cell"))
                c = c.withColumn("x", u01("far", F.col("i"), side, seed=seed)).withColumn("cell", F.floor(F.col("x") * cells)).join(ends, "cell").where("x >= low and x < high").drop("x", "cell", "low", "high")
        c = c.where("a <> b").select("i", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        c = c.groupBy("u", "v").agg(F.min("i").alias("i")).join(known, ["u", "v"], "left_anti")
        if found is not None:
            c = c.join(found, ["u", "v"], "left_anti")
        new = c.orderBy("i").limit(count - have).select("u", "v")
        found = cut(new if found is None else found.union(new), "far")
        have, start = found.count(), start + room
        if have >= count:
            break
    return found


# weights
def weight_flat(stats: DataFrame, window: int) -> DataFrame:
    return stats.withColumn("h", F.lit(1.0))


def weight_min_gap(stats: DataFrame, window: int) -> DataFrame:
    return stats.withColumn("h", F.col("mn").cast("double"))


def weight_mean_gap(stats: DataFrame, window: int) -> DataFrame:
    """The mean gap, to the nearest whole number (halves to even), within [1, window]."""
    return stats.withColumn("h", F.least(F.greatest(F.rint(F.col("sm") / F.greatest("cnt", F.lit(1))), F.lit(1.0)), F.lit(float(window))))


def weight_pmi(stats: DataFrame, window: int) -> DataFrame:
    """Pointwise mutual information between its 1st and 99th percentile, turned round onto whole numbers in [1, window]."""
    ends = stats.select(F.col("u").alias("id"), "cnt").union(stats.select(F.col("v").alias("id"), "cnt")).groupBy("id").agg(F.sum("cnt").alias("c"))
    total = stats.agg(F.sum("cnt").alias("t"))
    p = stats.join(ends.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(ends.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").join(F.broadcast(total))  # one row
    p = p.withColumn("pmi", F.log(F.col("cnt") * F.col("t") / (F.col("cu") * F.col("cv"))))
    lim = p.agg(F.percentile("pmi", F.array(F.lit(0.01), F.lit(0.99))).alias("lim"))
    p = p.join(F.broadcast(lim))  # one row
    lo, hi = F.col("lim")[0], F.col("lim")[1]
    x = (F.least(F.greatest("pmi", lo), hi) - lo) / (hi - lo)
    h = F.when(hi > lo, F.least(F.greatest(F.rint(window - x * (window - 1)), F.lit(1.0)), F.lit(float(window)))).otherwise(1.0)
    return p.withColumn("h", h).drop("cu", "cv", "t", "pmi", "lim")


WEIGHTS: dict[str, Callable] = {"flat": weight_flat, "min_gap": weight_min_gap, "mean_gap": weight_mean_gap, "pmi": weight_pmi}


def constant_far_weight(far: DataFrame, weight: float = 100.0) -> DataFrame:
    return far.withColumn("w", F.lit(float(weight)))


def landmark_far_weight(far: DataFrame, table: DataFrame, most: int = 32, scale: float = 1.0, fallback: float = 100.0) -> DataFrame:
    from .paths import landmark_distance

    est = landmark_distance(table, far, most)
    return est.select("u", "v", F.coalesce(F.col("est") * scale, F.lit(float(fallback))).alias("w"))


def freq_pair(stats: DataFrame) -> DataFrame:
    return stats.withColumn("freq", F.col("cnt").cast("double"))


def freq_node(stats: DataFrame) -> DataFrame:
    """Total visits of the partner over all rows; an aggregate and a join, as a hub's rows wouldn't fit one window."""
    total = stats.groupBy("v").agg(F.sum("cnt").cast("double").alias("freq"))
    return stats.join(total, "v")
