"""Draws of node pairs for measuring an embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import SEED, below, key, key_bound
from ..plans.state import cut
from .pairs import sample_far_pairs


def positives(edges: DataFrame, most: int, seed: int = SEED, draw: str = "over_cap") -> DataFrame:
    """u < v: edges, a drawn subset of ``most`` where there are more (or always shuffled with draw='always')."""
    e = edges.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if draw == "over_cap" and e.count() <= most:
        return e
    return e.withColumn("k", key("pos", F.col("u"), F.col("v"), seed=seed)).orderBy("k", "u", "v").limit(most).select("u", "v")


def negatives(nodes: DataFrame, edges: DataFrame, count: int, seed: int = SEED, sources: DataFrame | None = None, max_tries: int = 40) -> DataFrame:
    """i, u, v: ``count`` drawn pairs that aren't edges; a pair may come twice.  nodes(id, rank) is dense, sources(id, rank) too."""
    spark = nodes.sparkSession
    n, left = nodes.count(), sources if sources is not None else nodes
    m = left.count()
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    found, have, start = None, 0, 0
    for _ in range(max_tries):
        room = 2 * (count - have) + 1024
        c = spark.range(start, start + room).withColumnRenamed("id", "i")
        c = c.withColumn("ra", below(m, "neg", F.col("i"), "a", seed=seed)).join(left.select(F.col("rank").alias("ra"), F.col("id").alias("u")), "ra")
        c = c.withColumn("rb", below(n, "neg", F.col("i"), "b", seed=seed)).join(nodes.select(F.col("rank").alias("rb"), F.col("id").alias("v")), "rb")
        new = c.where("u <> v").select("i", "u", "v").join(e, ["u", "v"], "left_anti").orderBy("i").limit(count - have).select("i", "u", "v")
        found = cut(new if found is None else found.union(new), "neg")
        have, start = found.count(), start + room
        if have >= count:
            break
    return found


def distinct_negatives(nodes: DataFrame, edges: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """u < v: different pairs that aren't edges."""
    return sample_far_pairs(nodes, count, edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), seed)


def pairs_with_sources(nodes: DataFrame, edges: DataFrame, count: int, max_sources: int = 0, seed: int = SEED) -> DataFrame:
    """Non-edge pairs from at most ``max_sources`` different sources (0: any)."""
    from .graph import id_map

    sources = None
    if max_sources:
        few = nodes.withColumn("k", key("source", F.col("id"), seed=seed)).orderBy("k", "id").limit(max_sources).select("id")
        sources = cut(id_map(few.select(F.col("id").alias("src"), F.col("id").alias("dst"))).select(F.col("raw").alias("id"), F.col("id").alias("rank")), "sources")
    return negatives(nodes, edges, count, seed, sources)


def pairs_for_hops(nodes: DataFrame, edges: DataFrame, count: int, n_sources: int = 0, draw: str = "reject", seed: int = SEED) -> DataFrame:
    """u, v by a named draw: ``reject``, ``bfs_rows`` or ``stratified_by_hop``."""
    from .paths import bfs_rows

    if draw == "reject":
        return pairs_with_sources(nodes, edges, count, n_sources, seed).select("u", "v")
    few = nodes.withColumn("k", key("source", F.col("id"), seed=seed)).orderBy("k", "id").limit(n_sources or 200).select("id")
    if draw == "bfs_rows":
        return bfs_rows(edges, few, max(1, count // max(1, n_sources or 200)), seed)
    if draw == "stratified_by_hop":
        from .paths import bfs

        near = bfs(edges, few).where("dist > 0").select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").alias("hops"))
        return stratified(near, count, seed)
    raise KeyError(f"unknown draw {draw!r}; there are reject, bfs_rows, stratified_by_hop")


def stratified(pairs: DataFrame, count: int, seed: int = SEED, totals: dict[int, int] | None = None) -> DataFrame:
    """As many pairs from each hop: ``count`` over the number of different hops.

    With ``totals``, the number of pairs at each hop (from 1), pairs are read once and stored only where the key lies under a bound;
    hops of which it let through too few are read again.
    """
    from .pairs import _first_by_key

    if totals is not None:
        each = count // max(1, len(totals))
        spark = pairs.sparkSession
        if not totals:
            return pairs.limit(0)
        rows = spark.createDataFrame(sorted(totals.items()), "h int, n long").select("h", key_bound(F.lit(each), F.col("n")).alias("most"))
        most = {r.h: r.most for r in rows.collect()}  # as many as the diameter
        hop, k = F.col("hops").cast("int"), key("hop", F.col("u"), F.col("v"), seed=seed)
        bound = F.element_at(F.array(*[F.lit(most.get(h, "")) for h in range(1, max(most) + 1)]), hop)
        kept = cut(pairs.where(k < bound), "least")
        have = {r.h: r["count"] for r in kept.groupBy(hop.alias("h")).count().collect()}
        few = [h for h, n in totals.items() if have.get(h, 0) < min(each, n)]
        if few:
            kept = kept.where(~hop.isin(few)).unionByName(cut(pairs.where(hop.isin(few)), "whole"))
        return _first_by_key(kept.withColumn("stratum", hop).withColumn("k", k), dict.fromkeys(totals, each), ["u", "v"]).drop("stratum", "k")
    kinds = pairs.select("hops").distinct().count()
    each = count // max(1, kinds)
    rows = pairs.withColumn("stratum", F.col("hops").cast("int")).withColumn("k", key("hop", F.col("u"), F.col("v"), seed=seed))
    hops = [r[0] for r in rows.select("stratum").distinct().collect()]  # as many as the diameter
    return _first_by_key(rows, {h: each for h in hops}, ["u", "v"]).drop("stratum", "k")


def without_other_components(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs whose ends lie in one component."""
    a, b = components.select(F.col("id").alias("u"), F.col("component").alias("ca")), components.select(F.col("id").alias("v"), F.col("component").alias("cb"))
    return pairs.join(a, "u").join(b, "v").where("ca = cb").drop("ca", "cb")


def train_test(pairs: DataFrame, label: str, test: float = 0.2, seed: int = SEED, by: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Adds ``test``: the same share of each label, by a hash order."""
    from pyspark.sql import Window

    w = Window.partitionBy(label).orderBy(key("split", *[F.col(c) for c in by], seed=seed), *by)
    return pairs.withColumn("test", F.percent_rank().over(w) < test)


def bootstrap_index(n: int, resamples: int, spark, seed: int = SEED) -> DataFrame:
    """b, i, k: the i-th draw of resample b takes row k in [0, n)."""
    b = spark.range(resamples).withColumnRenamed("id", "b").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return b.withColumn("k", below(n, "boot", F.col("b"), F.col("i"), seed=seed))
