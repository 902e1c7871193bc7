"""Distances in graphs: breadth-first search as frontier joins, landmarks, weighted paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import key_bound
from ..plans.state import cut, fits
from .graph import degrees, nodes_of


def bfs(edges: DataFrame, sources: DataFrame, radius: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """source, node, dist for all nodes reached from sources(id), the source itself at 0; edges in both directions.

    Edges that may be broadcast, counted first, are searched for 64 sources a word by each task, without a shuffle.  Beyond
    that a level is one join of the frontier with the edges, less what is known.  With targets(source, node) it stops once
    all of them are found.
    """
    near = _searched(edges, sources.select("id").distinct(), radius) if targets is None else None
    if near is not None:
        return cut(near, "bfs")
    level = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("dist")).distinct()
    level = seen = cut(level, "bfs")
    before = level.limit(0)
    d = 0
    while radius is None or d < radius:
        d += 1
        step = edges.join(level.select("source", F.col("node").alias("src")), "src").select("source", F.col("dst").alias("node")).distinct()
        # edges lead both ways: a neighbour of this level is in the level before, in this one, or new
        known = level.select("source", "node").union(before.select("source", "node"))
        level, before = cut(step.join(known, ["source", "node"], "left_anti").withColumn("dist", F.lit(d)), "bfs"), level
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
        if d % 8 == 0:
            seen = cut(seen, "bfs")
        if targets is not None and targets.join(seen, ["source", "node"], "left_anti").isEmpty():
            break
    return seen


#: Sources that a task searches at once, 64 a word.
_AT_ONCE = 128
#: Edges read in one step of a level, so that what is gathered stays in the cache.
_STEP = 1 << 17


def _longs(*columns) -> bool:
    return {kind.typeName() for kind in columns} == {"long"}


def _shared(edges: DataFrame):
    """Broadcasts of the node ids and of the edges as numbers, those into one end together, four bytes each; None if they are too
    many or have nulls.  Tasks number and pack the edges, so the driver gets no more than it sends out."""
    m, whole = edges.agg(F.count(F.lit(1)), F.count(F.expr("src + dst"))).first()
    if m != whole or not fits(m, 4):
        return None
    nodes = nodes_of(edges)
    n = nodes.count()
    if not fits(4 * m + 8 * n, 1):
        return None
    sc = edges.sparkSession.sparkContext
    ids = sc.broadcast(np.sort(nodes.toArrow().column(0).to_numpy()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(np.searchsorted(ids.value, x.column(1).to_numpy()) << 32) | np.searchsorted(ids.value, x.column(0).to_numpy()) for x in batches]
        if both:
            both = np.unique(np.concatenate(both))
            ends, count = np.unique(both >> 32, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (both & 0xFFFFFFFF, ends, count)], names=["src", "ends", "count"])

    packed = edges.select("src", "dst").repartitionByRange(m // (1 << 20) + 1, "dst").mapInArrow(pack, "src binary, ends binary, count binary").toArrow()
    src, ends, count = (np.frombuffer(b"".join(packed.column(c).to_pylist()), np.int32) for c in ("src", "ends", "count"))
    first = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    at = np.unique(np.concatenate([np.searchsorted(first[:-1], np.arange(0, len(src), _STEP)), [len(ends)]])) if len(ends) else np.zeros(1, np.int64)
    steps = [(lo, hi, src[first[lo] : first[hi]].min(), src[first[lo] : first[hi]].max() + 1) for lo, hi in zip(at[:-1], at[1:])]
    return ids, sc.broadcast((src, ends, first, steps))


def _tools():
    """What tasks search with; made inside a function, it goes to them by value and they need not import this package."""

    def levels(shared, at: np.ndarray, radius: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Distance, bits (word, node) of what is first met at it, and of all met, from the nodes numbered ``at``."""
        n, (src, ends, first, steps) = len(shared[0].value), shared[1].value
        bit = np.arange(len(at))
        front = np.zeros((-(-len(at) // 64), n), np.uint64)
        front[bit // 64, at] = np.uint64(1) << (bit % 64).astype(np.uint64)
        seen, d = front.copy(), 0
        while radius is None or d < radius:
            d += 1
            new = np.zeros_like(front)
            for lo, hi, least, most in steps:
                if front[:, least:most].any():  # ids that lie together are often linked
                    part, starts = src[first[lo] : first[hi]].astype(np.int64), first[lo:hi] - first[lo]
                    for w in range(len(front)):
                        new[w, ends[lo:hi]] = np.bitwise_or.reduceat(front[w].take(part, mode="clip"), starts)
            front = new
            front &= ~seen
            if not front.any():
                return
            seen |= front
            yield d, front, seen

    def set_bits(bits: np.ndarray, low: int, count: int) -> np.ndarray:
        """0 or 1 by (node, source) of up to 4096 nodes from ``low``."""
        return np.unpackbits(np.ascontiguousarray(bits[:, low : low + 4096].T).view(np.uint8), axis=1, bitorder="little", count=count)

    def numbers(ids: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked ids are nodes, and the numbers of all (where they aren't, any)."""
        at = np.minimum(np.searchsorted(ids, asked), max(len(ids) - 1, 0))
        return (ids[at] == asked if len(ids) else np.zeros(len(asked), bool)), at

    return levels, set_bits, numbers


def _by_sources(sources: DataFrame, search, schema: str) -> DataFrame:
    """What ``search`` yields of some of the different ids at a time; of a null, what it yields of None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            if column.null_count:
                yield from search(None)
            asked = column.drop_null().to_numpy()
            for low in range(0, len(asked), _AT_ONCE):
                yield from search(asked[low : low + _AT_ONCE])

    sources = cut(sources, "sources")
    tasks = max(1, min(sources.count() // _AT_ONCE + 1, 10_000))
    return sources.repartitionByRange(tasks, "id").mapInArrow(run, schema)


def _searched(edges: DataFrame, sources: DataFrame, radius: int | None = None, fill: int | None = None, shared=None) -> DataFrame | None:
    """source, node, dist by bits over broadcast edges; ``fill`` is the distance of nodes out of reach, absent without it.

    None if the edges are too many, have nulls or aren't numbered by longs.  Tasks give out a row for a node and a distance with
    the list of the sources; only Spark's side, which doesn't store them, has a row for a pair.
    """
    if not _longs(edges.schema["src"].dataType, edges.schema["dst"].dataType, sources.schema["id"].dataType):
        return None
    shared = shared or _shared(edges)
    if shared is None:
        return None

    levels, set_bits, numbers = _tools()

    def told(count: np.ndarray, source: pa.Array, node: pa.Array, d: int) -> pa.RecordBatch:
        ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, source), node, pa.array(np.full(len(count), d, np.int32))], names=["sources", "node", "dist"])

    def search(asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if asked is None:
            yield told(np.ones(1, np.int64), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), 0)
            return
        ids = shared[0].value
        yield told(np.ones(len(asked), np.int64), pa.array(asked, pa.int64()), pa.array(asked, pa.int64()), 0)
        known, at = numbers(ids, asked)
        asked, at = asked[known], at[known]
        if not len(asked):
            return

        def rows(bits: np.ndarray, d: int) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(ids), 4096):
                node, k = np.nonzero(set_bits(bits, low, len(asked)))
                if len(k):
                    count = np.bincount(node)
                    some = np.nonzero(count)[0]
                    yield told(count[some], pa.array(asked[k], pa.int64()), pa.array(ids[low + some], pa.int64()), d)

        seen = None
        for d, front, seen in levels(shared, at, radius):
            yield from rows(front, d)
        if fill is not None:
            if seen is None:  # nodes have edges, but perhaps none that leads away
                seen = np.zeros((-(-len(at) // 64), len(ids)), np.uint64)
                seen[np.arange(len(at)) // 64, at] = np.uint64(1) << (np.arange(len(at)) % 64).astype(np.uint64)
            yield from rows(~seen, fill)

    return _by_sources(sources, search, "sources array<long>, node long, dist int").select(F.explode("sources").alias("source"), "node", "dist")


def _shells(edges: DataFrame, sources: DataFrame, shared=None) -> DataFrame | None:
    """u, h, n: how many nodes lie at each distance above 0, counted in the tasks; None where ``_searched`` is None."""
    if not _longs(edges.schema["src"].dataType, edges.schema["dst"].dataType, sources.schema["id"].dataType):
        return None
    shared = shared or _shared(edges)
    if shared is None:
        return None
    levels, set_bits, numbers = _tools()

    def search(asked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if asked is None:
            return
        known, at = numbers(shared[0].value, asked)
        asked, at = asked[known], at[known]
        if not len(asked):
            return
        for d, front, _ in levels(shared, at):
            met = front[:, front.any(axis=0)]
            count = sum(set_bits(met, low, len(asked)).sum(axis=0, dtype=np.int64) for low in range(0, met.shape[1], 4096))
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(asked[some], pa.int64()), pa.array(np.full(some.sum(), d, np.int32)), pa.array(count[some])], names=["u", "h", "n"])

    return _by_sources(sources, search, "u long, h int, n long")


def _pair_hops(edges: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """u, v, dist of the different pairs that are connected, by bits over broadcast edges: only the asked ends leave a task,
    and a group of sources ends with its last end found.  None where ``_searched`` is None."""
    if not _longs(edges.schema["src"].dataType, edges.schema["dst"].dataType, pairs.schema["u"].dataType, pairs.schema["v"].dataType):
        return None
    shared = _shared(edges)
    if shared is None:
        return None

    levels, _, numbers = _tools()

    def told(u: np.ndarray, v: np.ndarray, d: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(u), d, np.int32))], names=["u", "v", "dist"])

    def search(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = shared[0].value
        yield told(u[u == v], v[u == v], 0)
        (ku, a), (kv, b) = numbers(ids, u), numbers(ids, v)
        known = (u != v) & ku & kv
        u, v, a, b = u[known], v[known], a[known], b[known]
        if not len(u):
            return
        starts, k = np.unique(a, return_inverse=True)
        for d, front, _ in levels(shared, starts):
            hit = (front[k // 64, b] >> (k % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield told(u[hit], v[hit], d)
            u, v, b, k = u[~hit], v[~hit], b[~hit], k[~hit]
            if not len(u):
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(i).to_numpy() for i in (0, 1))
            _, k = np.unique(u, return_inverse=True)
            for low in range(0, int(k.max(initial=-1)) + 1, _AT_ONCE):
                part = (k >= low) & (k < low + _AT_ONCE)
                yield from search(u[part], v[part])

    asked = cut(pairs.select("u", "v").where("u is not null and v is not null").distinct(), "asked")
    tasks = max(1, min(asked.count() // _AT_ONCE + 1, 10_000))
    return cut(asked.repartitionByRange(tasks, "u").mapInArrow(run, "u long, v long, dist int"), "hops")


def _connected(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(u, v) of nodes in one component; each task joins its edges into trees of numbered nodes, the driver their trees."""
    edges = edges.select("src", "dst").where("src < dst or dst < src")
    nodes = nodes_of(edges)
    n = nodes.count()
    if not fits(n, 16):
        from .graph import components

        of = components(edges)
        a, b = of.select(F.col("id").alias("u"), F.col("component").alias("a")), of.select(F.col("id").alias("v"), F.col("component").alias("b"))
        return pairs.join(a, "u").join(b, "v").where("a = b").select("u", "v")
    sc = edges.sparkSession.sparkContext
    ids = sc.broadcast(np.sort(nodes.toArrow().column(0).to_numpy()))
    _, _, numbers = _tools()

    def tie(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each node's root, with a and b tied."""
        while True:
            a, b = root[a], root[b]
            apart = a != b
            if not apart.any():
                return root
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held, rows = np.arange(n, dtype=np.int32), [], 0
        for batch in batches:
            held.append([np.searchsorted(ids.value, batch.column(i).to_numpy()) for i in (0, 1)])
            rows += batch.num_rows
            if rows > 1 << 20:
                root, held, rows = tie(root, *map(np.concatenate, zip(*held))), [], 0
        if held:
            root = tie(root, *map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array([root.tobytes()], pa.binary())], names=["root"])

    # eight rows of four bytes a node come to the driver, one after the other
    root = np.arange(n, dtype=np.int32)
    for row in edges.coalesce(8).mapInArrow(trees, "root binary").toLocalIterator():
        root = tie(root, np.arange(n), np.frombuffer(row.root, np.int32))
    root = sc.broadcast(root)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ku, a), (kv, b) = (numbers(ids.value, batch.column(i).to_numpy()) for i in (0, 1))
            yield batch.filter(pa.array(ku & kv & (root.value[a] == root.value[b]) if n else ku))

    return pairs.select("u", "v").mapInArrow(kept, "u long, v long")


def _met_hops(edges: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """u, v, dist of the different pairs that are connected, by joins: levels from both ends, the smaller next, until they meet.

    A path of a + b steps has a node a steps from one end and b from the other, so only the newest levels are compared; ends whose
    pairs have all met go no further.  Pairs of different components are left out first: they would never meet.  Pairs over 12
    apart, in graphs of long ways and thin levels, are searched from one end.
    """
    if not _longs(edges.schema["src"].dataType, edges.schema["dst"].dataType, pairs.schema["u"].dataType, pairs.schema["v"].dataType):
        return None
    asked = cut(pairs.select("u", "v").where("u is not null and v is not null").distinct(), "asked")
    found = asked.where("u = v").select("u", "v", F.lit(0).alias("dist"))
    left = cut(_connected(edges, asked.where("u <> v")), "left")
    level = {x: cut(left.select(F.col(x).alias("source"), F.col(x).alias("node")).distinct(), "level") for x in "uv"}
    before, rows, d = {x: level[x].limit(0) for x in "uv"}, {x: level[x].count() for x in "uv"}, 0
    while d < 12 and not left.isEmpty():
        d += 1
        x = min("uv", key=rows.get)
        ends = level[x].join(left.select(F.col(x).alias("source")).distinct(), "source", "left_semi").select("source", F.col("node").alias("src"))
        step = edges.join(F.broadcast(ends) if fits(rows[x], 16) else ends, "src").select("source", F.col("dst").alias("node")).distinct()
        new = cut(step.join(level[x].union(before[x]), ["source", "node"], "left_anti"), "level")
        level[x], before[x], rows[x] = new, level[x], new.count()
        a, b = (level[y].select(F.col("source").alias(y), "node") for y in "uv")
        met = cut(left.join(a, "u").join(b, ["v", "node"]).select("u", "v").distinct().withColumn("dist", F.lit(d)), "met")
        found, left = found.union(met), left.join(met, ["u", "v"], "left_anti")
        if d % 8 == 0:
            found = cut(found, "found")
        left = cut(left, "left")
    if not left.isEmpty():
        near = bfs(edges, left.select(F.col("u").alias("id")).distinct())
        found = found.union(left.join(near.select(F.col("source").alias("u"), F.col("node").alias("v"), "dist"), ["u", "v"]))
    return found


def all_pairs(edges: DataFrame, radius: int | None = None) -> DataFrame:
    """u, v, h: hops between all pairs that are connected (within the radius); for small graphs or small radii.

    Where the search goes by bits its rows are not stored: they are for one use, and what is counted comes from ``all_shells``.
    """
    nodes = nodes_of(edges)
    near = _searched(edges, nodes, radius)
    return (bfs(edges, nodes, radius) if near is None else near).where("dist > 0").select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").alias("h"))


def hop_fill(edges: DataFrame) -> DataFrame:
    """u, v, h for every pair of nodes of a small graph: 0 to itself, n where there is no path."""
    nodes = nodes_of(edges)
    n = nodes.count()
    filled = _searched(edges, nodes, fill=n)
    if filled is not None:
        return filled.select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").alias("h"))
    pairs = nodes.select(F.col("id").alias("u")).crossJoin(nodes.select(F.col("id").alias("v")))  # the result itself has n * n rows
    near = bfs(edges, nodes).select(F.col("source").alias("u"), F.col("node").alias("v"), "dist")
    return pairs.join(near, ["u", "v"], "left").select("u", "v", F.coalesce("dist", F.lit(n)).alias("h"))


def shell_counts(pairs: DataFrame) -> DataFrame:
    """u, h, n: how many nodes lie at each distance."""
    return pairs.groupBy("u", "h").agg(F.count(F.lit(1)).alias("n"))


def all_shells(edges: DataFrame) -> DataFrame:
    """u, h, n for all nodes: ``shell_counts`` of ``all_pairs``, without a row for a pair where the search goes by bits."""
    counted = _shells(edges, nodes_of(edges))
    return shell_counts(all_pairs(edges)) if counted is None else counted


def pairs_and_totals(edges: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``all_pairs``, and their number at each distance: as many as the diameter."""
    nodes = nodes_of(edges)
    shared = _shared(edges) if _longs(edges.schema["src"].dataType, edges.schema["dst"].dataType) else None
    if shared is None:
        pairs = all_pairs(edges)
        shells = hop_histogram(pairs)
    else:
        pairs = _searched(edges, nodes, shared=shared).where("dist > 0").select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").alias("h"))
        shells = _shells(edges, nodes, shared).groupBy("h").agg(F.sum("n").alias("n"))
    return pairs, {r.h: r.n for r in shells.collect()}


def hop_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def pick_landmarks(edges: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """Half of them the nodes of highest degree (ties by id), the rest drawn."""
    deg = degrees(edges)
    top = deg.orderBy(F.desc("deg"), "id").limit(count // 2).select("id")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("landmark"), F.col("id").cast("string")))
    rest = deg.join(top, "id", "left_anti").orderBy(key, "id").limit(count - count // 2).select("id")
    return top.union(rest)


def hub_landmarks(edges: DataFrame, count: int = 32, seed: int = 42) -> DataFrame:
    """Drawn from the 8 * count nodes of highest degree."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("hubs"), F.col("id").cast("string")))
    return degrees(edges).orderBy(F.desc("deg"), "id").limit(8 * count).orderBy(key, "id").limit(count).select("id")


def landmark_table(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """landmark, node, dist; nodes out of reach are absent."""
    return bfs(edges, landmarks).select(F.col("source").alias("landmark"), "node", F.col("dist").cast("short").alias("dist"))


def landmark_distance(table: DataFrame, pairs: DataFrame, most: int | None = None, fallback: float | None = None) -> DataFrame:
    """pairs(u, v) with ``est``: the least detour over a landmark, an upper bound; clipped into [1, most] if given.

    Each node has one row a landmark, so the join on (landmark) goes through the pair's own nodes, never all pairs.
    """
    a = table.select("landmark", F.col("node").alias("u"), F.col("dist").alias("da"))
    b = table.select("landmark", F.col("node").alias("v"), F.col("dist").alias("db"))
    est = pairs.select("u", "v").distinct().join(a, "u").join(b, ["v", "landmark"]).groupBy("u", "v").agg(F.min(F.col("da") + F.col("db")).cast("double").alias("est"))
    out = pairs.join(est, ["u", "v"], "left")
    if most is not None:
        out = out.withColumn("est", F.least(F.greatest("est", F.lit(1.0)), F.lit(float(most))))
    return out if fallback is None else out.withColumn("est", F.coalesce("est", F.lit(float(fallback))))


def hop_distance(edges: DataFrame, pairs: DataFrame, backend: str = "bfs", landmarks: int = 64, seed: int = 42) -> DataFrame:
    """pairs(u, v) with ``hops`` (null: no path).  ``bfs`` is exact, ``landmark`` an upper bound."""
    if backend in ("auto", "bfs"):
        found = _pair_hops(edges, pairs)
        if found is None:
            found = _met_hops(edges, pairs)
        if found is not None:
            return pairs.join(found.select("u", "v", F.col("dist").cast("double").alias("hops")), ["u", "v"], "left")
        near = bfs(edges, pairs.select(F.col("u").alias("id")).distinct(), targets=None)
        return pairs.join(near.select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").cast("double").alias("hops")), ["u", "v"], "left")
    if backend == "landmark":
        return landmark_distance(landmark_table(edges, pick_landmarks(edges, landmarks, seed)), pairs).withColumnRenamed("est", "hops")
    raise KeyError(f"unknown backend {backend!r}; there are auto, bfs, landmark")


def weighted_paths(edges: DataFrame, sources: DataFrame, weight: str = "w") -> DataFrame:
    """source, node, dist: least sums of weights, by min-plus rounds until nothing falls.

    Only nodes whose distance fell in the last round are extended.
    """
    best = cut(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist")), "dist")
    front = best
    while True:
        step = edges.join(front.select("source", F.col("node").alias("src"), "dist"), "src").groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col(weight)).alias("new"))
        both = cut(best.join(step, ["source", "node"], "full").select("source", "node", F.col("dist").alias("was"), F.least(F.coalesce("dist", "new"), F.coalesce("new", "dist")).alias("dist")), "dist")
        best = both.select("source", "node", "dist")
        front = both.where("was is null or dist < was").select("source", "node", "dist")
        if front.isEmpty():
            return best


def weighted_hop_fill(edges: DataFrame, weight: str = "w") -> DataFrame:
    """u, v, h of a small weighted graph; pairs without a path get the greatest finite distance."""
    nodes = nodes_of(edges)
    near = cut(weighted_paths(edges, nodes, weight), "near")
    far = near.agg(F.max("dist")).first()[0]
    pairs = nodes.select(F.col("id").alias("u")).crossJoin(nodes.select(F.col("id").alias("v")))  # the result itself has n * n rows
    return pairs.join(near.select(F.col("source").alias("u"), F.col("node").alias("v"), "dist"), ["u", "v"], "left").select("u", "v", F.coalesce("dist", F.lit(far)).alias("h"))


def edges_and_sampled(edges: DataFrame, pairs_with_hops: DataFrame, n: int) -> DataFrame:
    """u, v, h: edges at 1 and sampled pairs at their true hops (n: no path), both directions."""
    p = pairs_with_hops.select("u", "v", F.coalesce("hops", F.lit(float(n))).alias("h"))
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("h")).union(p).union(p.select("v", "u", "h"))


def hop_sample(true: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored gaps (u, v, h) against true hops (u, v, hops): shares of exact, over and under, mean error."""
    both = true.join(stored, ["u", "v"]).where("hops is not null")
    d = F.col("h") - F.col("hops")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((d > 0).cast("double")).alias("over"), F.avg((d < 0).cast("double")).alias("under"), F.avg(F.abs(d)).alias("mae"))


def bfs_rows(edges: DataFrame, sources: DataFrame, per: int, seed: int = 42) -> DataFrame:
    """u, v, hops: for each source up to ``per`` of ``2 * per`` drawn targets that lie at a finite distance above 0."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("rows"), F.col("u").cast("string"), F.col("v").cast("string")))
    near = _least_keys(edges, sources, 2 * per, key)
    if near is None:
        near = bfs(edges, sources).select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").alias("hops"))
    first = near.withColumn("k", key).withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("k", "v"))).where(F.col("r") <= 2 * per).where("hops > 0")
    return first.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("r"))).where(F.col("r") <= per).select("u", "v", "hops")


def _least_keys(edges: DataFrame, sources: DataFrame, count: int, key: Column) -> DataFrame | None:
    """u, v, hops: of each source's reached nodes at least the ``count`` of the least keys; None where the search goes by joins.

    A key is an even draw of hex digits, so a bound by the number of nodes reached lets through a few more than ``count``, and only
    those are stored; sources of which it let through too few are stored whole.
    """
    sources = sources.select("id").distinct()
    shared = _shared(edges) if _longs(edges.schema["src"].dataType, edges.schema["dst"].dataType, sources.schema["id"].dataType) else None
    if shared is None:
        return None
    shells = _shells(edges, sources, shared)
    reached = cut(shells.groupBy("u").agg((F.sum("n") + 1).alias("n")), "reached")
    bounds = reached.select("u", key_bound(F.lit(count), F.col("n")).alias("most"))
    bounds = F.broadcast(bounds) if fits(reached.count(), 24) else bounds
    told = lambda df: df.select(F.col("source").alias("u"), F.col("node").alias("v"), F.col("dist").alias("hops"))
    kept = cut(told(_searched(edges, sources, shared=shared)).join(bounds, "u").where(key < F.col("most")).select("u", "v", "hops"), "least")
    have = kept.groupBy("u").agg(F.count(F.lit(1)).alias("have"))
    few = cut(reached.join(have, "u", "left").where(F.coalesce("have", F.lit(0)) < F.least(F.lit(count), F.col("n"))).select(F.col("u").alias("id")), "few")
    if few.isEmpty():
        return kept
    return kept.join(few.select(F.col("id").alias("u")), "u", "left_anti").unionByName(cut(told(_searched(edges, few, shared=shared)), "whole"))
