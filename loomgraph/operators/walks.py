"""Random walks.  The relational form extends all walks by one equi-join a step; the block form walks on broadcast arrays.

Both use the same hash draws and give the same walks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import SEED, below, below_py, u01
from ..plans.state import cut, fits
from .graph import indexed, nodes_of


def starts_of(nodes: DataFrame, n_walks: int) -> DataFrame:
    """walk_id, start: every node ``n_walks`` times; walk_id is start * n_walks + r."""
    return nodes.select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(n_walks - 1))).alias("r")).select((F.col("start") * n_walks + F.col("r")).cast("long").alias("walk_id"), F.col("start").cast("long").alias("start"))


def uniform_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = SEED) -> DataFrame:
    """walk_id, start, path of ``length`` nodes; a walk at a node without edges stays there.

    The k-th neighbour is an equi-join on (node, k): a hub's neighbours spread over all tasks.
    """
    ix = cut(indexed(edges), "indexed")
    deg = ix.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    w = starts.withColumn("node", F.col("start")).join(deg, "node", "left").select("walk_id", "start", "node", F.coalesce("deg", F.lit(0)).alias("deg"), F.array("start").alias("path"))
    step = ix.select(F.col("src").alias("node"), "k", F.col("dst").alias("to"), F.col("dst_deg"))
    for t in range(1, length):
        w = w.withColumn("k", F.when(F.col("deg") > 0, below(F.greatest("deg", F.lit(1)), "walk", F.col("walk_id"), t, seed=seed)).otherwise(F.lit(-1)))
        w = w.join(step, ["node", "k"], "left")
        to = F.coalesce("to", "node")
        w = w.select("walk_id", "start", to.alias("node"), F.coalesce("dst_deg", "deg").alias("deg"), F.concat("path", F.array(to)).alias("path"))
        if t % 8 == 0:
            w = cut(w, "walks")
    return w.select("walk_id", "start", "path")


def node2vec_walks(edges: DataFrame, starts: DataFrame, length: int, p: float = 1.0, q: float = 1.0, tries: int = 20, seed: int = SEED) -> DataFrame:
    """Second-order walks by rejection: weight 1/p back, 1 to a common neighbour, 1/q elsewhere; the last draw is taken if all fail."""
    ix = cut(indexed(edges), "indexed")
    deg = ix.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    top = max(1.0, 1.0 / p, 1.0 / q)
    w = starts.withColumn("node", F.col("start")).join(deg, "node", "left").select("walk_id", "start", "node", F.coalesce("deg", F.lit(0)).alias("deg"), F.array("start").alias("path"), F.lit(None).cast("long").alias("prev"))
    near = edges.select(F.col("src").alias("prev"), F.col("dst").alias("to"), F.lit(1).alias("common"))
    step = ix.select(F.col("src").alias("node"), "k", F.col("dst").alias("to"), "dst_deg")
    for t in range(1, length):
        draws = F.explode(F.when(F.col("prev").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(tries - 1))))
        c = w.withColumn("try", draws).withColumn("k", F.when(F.col("deg") > 0, below(F.greatest("deg", F.lit(1)), "walk2", F.col("walk_id"), t, F.col("try"), seed=seed)).otherwise(F.lit(-1)))
        c = c.join(step, ["node", "k"], "left").join(near, ["prev", "to"], "left")
        weight = F.when(F.col("prev").isNull(), top).when(F.col("to") == F.col("prev"), 1.0 / p).when(F.col("common").isNotNull(), 1.0).otherwise(1.0 / q)
        ok = u01("accept", F.col("walk_id"), t, F.col("try"), seed=seed) * top < weight
        rank = F.when(ok, F.col("try")).otherwise(F.lit(2 * tries) - F.col("try"))
        best = c.groupBy("walk_id").agg(F.min(F.struct(rank.alias("r"), "start", "node", "deg", "path", "to", "dst_deg")).alias("b")).select("walk_id", "b.*")
        to = F.coalesce("to", "node")
        w = best.select("walk_id", "start", to.alias("node"), F.coalesce("dst_deg", "deg").alias("deg"), F.concat("path", F.array(to)).alias("path"), F.col("node").alias("prev"))
        if t % 4 == 0:
            w = cut(w, "walks")
    return w.select("walk_id", "start", "path")


def weighted_second_order(edges: DataFrame, starts: DataFrame, length: int, p: float = 1.0, q: float = 1.0, seed: int = SEED) -> DataFrame:
    """Second-order walks by an exact weighted choice at each step; a walk ends at a node without edges."""
    near = edges.select(F.col("src").alias("prev"), F.col("dst").alias("to"), F.lit(1).alias("common"))
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    w = starts.select("walk_id", "start", F.col("start").alias("node"), F.lit(None).cast("long").alias("prev"), F.array("start").alias("path"))
    done = None
    for t in range(1, length):
        c = w.join(step, "node").join(near, ["prev", "to"], "left")
        weight = F.when(F.col("prev").isNull(), 1.0).when(F.col("to") == F.col("prev"), 1.0 / p).when(F.col("common").isNotNull(), 1.0).otherwise(1.0 / q)
        # exponential race: the least -log(u) / weight is a draw by weight
        race = -F.log(F.lit(1.0) - u01("race", F.col("walk_id"), t, F.col("to"), seed=seed)) / weight
        best = c.groupBy("walk_id").agg(F.min(F.struct(race.alias("r"), "to", "start", "node", "path")).alias("b")).select("walk_id", "b.*")
        stuck = w.join(best.select("walk_id"), "walk_id", "left_anti").select("walk_id", "start", "path")
        done = stuck if done is None else done.union(stuck)
        w = best.select("walk_id", "start", F.col("to").alias("node"), F.col("node").alias("prev"), F.concat("path", F.array("to")).alias("path"))
        if t % 4 == 0:
            w, done = cut(w, "walks"), cut(done, "done")
    alive = w.select("walk_id", "start", "path")
    return alive if done is None else alive.union(done)


def block_walks(edges: DataFrame, starts: DataFrame, length: int, seed: int = SEED) -> DataFrame:
    """The same walks as uniform_walks on arrays; only where the graph's measured size may be broadcast, else relational."""
    m = edges.count()
    if not fits(m, 16):
        return uniform_walks(edges, starts, length, seed)
    e = edges.orderBy("src", "dst").toPandas()
    ids, first = np.unique(e["src"].to_numpy(), return_index=True)
    shared = edges.sparkSession.sparkContext.broadcast((ids, np.append(first, len(e)), e["dst"].to_numpy()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, ptr, dst = shared.value
        for b in batches:
            paths = []
            for walk, start in zip(b["walk_id"], b["start"], strict=True):
                path, at = [start], start
                for t in range(1, length):
                    i = int(np.searchsorted(ids, at))
                    if i < len(ids) and ids[i] == at:
                        at = int(dst[ptr[i] + below_py(int(ptr[i + 1] - ptr[i]), "walk", walk, t, seed=seed)])
                    path.append(at)
                paths.append(path)
            yield pd.DataFrame({"walk_id": b["walk_id"], "start": b["start"], "path": paths})

    return starts.select("walk_id", "start").mapInPandas(run, "walk_id long, start long, path array<long>")


def walker(edges: DataFrame, p: float = 1.0, q: float = 1.0):
    """The walk for p and q: first order when both are 1."""
    if p == 1.0 and q == 1.0:
        return lambda starts, length, seed=SEED: uniform_walks(edges, starts, length, seed)
    return lambda starts, length, seed=SEED: node2vec_walks(edges, starts, length, p, q, seed=seed)


def graph_walk(edges: DataFrame, n_walks: int, length: int, p: float = 1.0, q: float = 1.0, seed: int = SEED) -> DataFrame:
    return walker(edges, p, q)(starts_of(nodes_of(edges), n_walks), length, seed)
