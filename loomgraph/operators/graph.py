"""Graphs as tables: ``edges(src, dst)`` in both directions without loops or repeats, ``nodes(id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import below
from ..functions.stats import pearson
from ..plans.state import cut


def symmetric(raw: DataFrame) -> DataFrame:
    """Both directions, each once, no loops.

    A union of both directions measured faster than one pass that makes two rows of each: Spark reuses the shuffled input.
    """
    e = raw.select("src", "dst").where("src <> dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nodes_of(edges: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """The ends of the edges, and with ``also`` (id) nodes that may have none."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return (ids if also is None else ids.union(also.select("id"))).distinct()


def base_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (id) and a table of no edges between them, to which strategies add."""
    ids = nodes.select(F.col("id").cast("long").alias("id")).distinct()
    return ids, ids.select(F.col("id").alias("src"), F.col("id").alias("dst")).where("false")


def id_map(raw: DataFrame) -> DataFrame:
    """raw, id: dense numbers in the order of the raw ids.

    Ranges are sorted apart and numbered from the counts of the ranges before, so no task sees all ids.
    """
    ids = cut(nodes_of(raw).withColumnRenamed("id", "raw").repartitionByRange("raw").sortWithinPartitions("raw").withColumn("part", F.spark_partition_id()), "ids")
    # one row a partition comes to the driver
    counts = {r.part: r.n for r in ids.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(at)]
        at += counts[p]
    if not before:
        return ids.select("raw", F.lit(0).cast("long").alias("id"))
    w = Window.partitionBy("part").orderBy("raw")
    return ids.select("raw", (F.row_number().over(w) - 1 + F.element_at(F.create_map(*before), F.col("part"))).cast("long").alias("id"))


def renumber(raw: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The same edges in dense numbers, direction kept (for trees)."""
    ids = ids if ids is not None else id_map(raw)
    a = ids.select(F.col("raw").alias("src"), F.col("id").alias("s"))
    b = ids.select(F.col("raw").alias("dst"), F.col("id").alias("d"))
    return raw.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def to_graph(raw: DataFrame) -> DataFrame:
    """Loops out, dense numbers, both directions."""
    return symmetric(renumber(raw.where("src <> dst")))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, deg; nodes without an edge have degree 0."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    return d if nodes is None else nodes.select("id").join(d, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("deg").agg(F.count(F.lit(1)).alias("n_nodes"))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in keep(id)."""
    a, b = keep.select(F.col("id").alias("src")), keep.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def induced_renumbered(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The induced graph in numbers of the place in keep's order."""
    ids = id_map(keep.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    return renumber(induced(edges, keep), ids)


def indexed(edges: DataFrame) -> DataFrame:
    """src, k, dst, deg (of src), dst_deg: the k-th neighbour of each node, neighbours in order."""
    w = Window.partitionBy("src").orderBy("dst")
    deg = degrees(edges)
    e = edges.withColumn("k", (F.row_number().over(w) - 1).cast("long"))
    e = e.join(deg.select(F.col("id").alias("dst"), F.col("deg").alias("dst_deg")), "dst", "left").withColumn("dst_deg", F.coalesce("dst_deg", F.lit(0)))
    return e.select("src", "k", "dst", "dst_deg")


def ball(edges: DataFrame, max_nodes: int, seed: int = 42) -> DataFrame:
    """The graph on the first ``max_nodes`` nodes met from a drawn start, nearest first, then by id."""
    from .paths import bfs

    nodes = nodes_of(edges)
    start = nodes.select("id", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("ball"), F.col("id").cast("string"))).alias("h")).orderBy("h", "id").limit(1).select("id")
    near = bfs(edges, start)
    keep = near.orderBy("dist", "node").limit(max_nodes).select(F.col("node").alias("id"))
    return induced(edges, cut(keep, "ball"))


def subtree(tree: DataFrame, cap: int, seed: int = 42, climbs: int = 200) -> DataFrame:
    """A part of a child -> parent tree: climb from a drawn node until the set below holds at least cap // 2 nodes.

    The set is filled level by level, by id within a level, up to cap.  Returns the child -> parent edges inside it.
    Where a child has several parents the greatest counts.
    """
    up = tree.where("src <> dst").groupBy("src").agg(F.max("dst").alias("dst"))
    up = cut(up, "tree")
    at = up.select("src").withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("subtree"), F.col("src").cast("string")))).orderBy("h", "src").limit(1).first()[0]
    below = None
    for _ in range(climbs):
        below = descendants(up, at, cap)
        if below.count() >= cap // 2:
            break
        parent = up.where(F.col("src") == at).select("dst").first()
        if parent is None:
            break
        at = parent[0]
    keep = below.orderBy("depth", "id").limit(cap).select("id")
    return induced(up, keep)


def descendants(up: DataFrame, root, cap: int | None = None) -> DataFrame:
    """id, depth of all nodes under (and with) root, level by level; stops once more than cap are found."""
    spark = up.sparkSession
    kind = up.schema["src"].dataType
    level = spark.createDataFrame([(root,)], "id long").select(F.col("id").cast(kind).alias("id"), F.lit(0).alias("depth"))
    seen = level
    while True:
        down = up.join(level.select(F.col("id").alias("dst"), "depth"), "dst").select(F.col("src").alias("id"), (F.col("depth") + 1).alias("depth")).distinct()
        level = cut(down.join(seen.select("id"), "id", "left_anti"), "level")
        if level.isEmpty():
            return seen
        seen = cut(seen.union(level), "seen")
        if cap is not None and seen.count() > cap:
            return seen


def components(edges: DataFrame) -> DataFrame:
    """id, component: the least id reachable.  Least labels of neighbours, then jumps to the label's own label."""
    edges = cut(edges.select("src", "dst"), "edges")  # read in each round
    labels = cut(nodes_of(edges).select("id", F.col("id").alias("component")), "label")
    while True:
        near = edges.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("c"))
        jump = step.select(F.col("id").alias("c"), F.col("c").alias("far"))
        step = cut(step.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("far", "c")).alias("component")), "label")
        labels = step.select("id", "component")
        if step.where("was <> component").isEmpty():
            return labels


def bipartite(edges: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """component, bipartite: no edge joins two nodes at distances of equal parity from the least node."""
    from .paths import bfs

    comp = components(edges) if comp is None else comp
    near = bfs(edges, comp.select(F.col("component").alias("id")).distinct())
    side = near.select("node", F.col("source").alias("component"), (F.col("dist") % 2).alias("side"))
    a = side.withColumnRenamed("node", "src").withColumnRenamed("side", "sa")
    b = side.select(F.col("node").alias("dst"), F.col("side").alias("sb"))
    return edges.join(a, "src").join(b, "dst").groupBy("component").agg((F.sum((F.col("sa") == F.col("sb")).cast("int")) == 0).alias("bipartite"))


def assortativity(edges: DataFrame) -> DataFrame:
    """Correlation of the degrees at both ends of the edges."""
    d = degrees(edges)
    both = edges.join(d.select(F.col("id").alias("src"), F.col("deg").alias("da")), "src").join(d.select(F.col("id").alias("dst"), F.col("deg").alias("db")), "dst")
    return both.agg(pearson("da", "db").alias("assortativity"))


def profile(edges: DataFrame, sweeps: int = 8) -> dict:
    """Size, degree, components, an estimate of the diameter by double sweeps, shape and class."""
    from .paths import bfs

    n = nodes_of(edges).count()
    m = edges.where("src < dst").count()
    top = degrees(edges).agg(F.max("deg")).first()[0] or 0
    comp = components(edges)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    count, giant = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    starts = nodes_of(edges).orderBy(F.md5(F.col("id").cast("string"))).limit(sweeps)
    far = bfs(edges, starts).groupBy("source").agg(F.max_by("node", F.struct("dist", "node")).alias("id")).select("id").distinct()
    diameter = bfs(edges, far).agg(F.max("dist")).first()[0] or 0
    two = bipartite(edges, comp).agg(F.min("bipartite")).first()[0] if m else True
    is_tree = m == n - count
    return {"n": n, "m": m, "avg_degree": 2 * m / n if n else 0.0, "max_degree": top, "components": count, "giant": (giant or 0) / n if n else 0.0, "diameter": diameter, "is_tree": is_tree, "bipartite": bool(two), "assortativity": assortativity(edges).first()[0], "class": "S" if diameter > 20 else "H"}


def label_propagation(edges: DataFrame, rounds: int = 10, seed: int = 42) -> DataFrame:
    """id, label: each round a node takes the label most frequent among its neighbours, ties by the least label.

    Half of the nodes move in a round (by a hash), which keeps two sides from swapping labels for ever.
    """
    labels = cut(nodes_of(edges).select("id", F.col("id").alias("label")), "lp")
    for r in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("b")).select("id", (-F.col("b.neg")).alias("new"))
        moves = below(2, "lp", r, F.col("id"), seed=seed) == 0
        step = cut(labels.join(best, "id", "left").select("id", F.col("label").alias("was"), F.when(moves, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label")), "lp")
        labels = step.select("id", "label")
        if step.where("was <> label").isEmpty() and r > 0:
            break
    return labels


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """id, rank; ranks sum to 1 (every node has an edge)."""
    nodes = nodes_of(edges)
    n = nodes.count()
    deg = cut(degrees(edges), "deg")
    rank = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for r in range(rounds):
        share = rank.join(deg, "id").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("share"))
        rank = edges.join(share, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("s")).select("id", ((1 - damping) / n + damping * F.col("s")).alias("rank"))
        if r % 4 == 3:
            rank = cut(rank, "rank")
    return rank


def conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """label, conductance: edges that leave a cluster over the smaller of its volume and the rest's."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    per = edges.join(a, "src").join(b, "dst").groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("vol"), F.sum((F.col("la") != F.col("lb")).cast("long")).alias("cut"))
    total = per.agg(F.sum("vol").alias("all"))
    side = F.least(F.col("vol"), F.col("all") - F.col("vol"))
    return per.join(F.broadcast(total)).select("label", F.when(side > 0, F.col("cut") / side).alias("conductance"))  # total is one row
