"""Queries on graphs, distances and walks, with DuckDB's forms."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import below_sql, u01_sql
from ..operators import graph as G
from ..operators import paths as D
from ..operators import walks as W
from ..sources import tables as T
from .state import cut

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def edges(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return G.symmetric(getattr(T, name)(spark, sf))


def with_edges(name: str, rest: str) -> str:
    return f"WITH RECURSIVE {T.edges_sql(name)}, deg AS MATERIALIZED (SELECT src AS id, count(*)::BIGINT AS deg FROM e GROUP BY src){rest}"


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) for n in names])


for _name in ("basket", "supply", "users"):
    Q[f"edges_symmetric_{_name}"] = partial(lambda spark, sf, name: edges(spark, sf, name), name=_name)
    SQL[f"edges_symmetric_{_name}"] = with_edges(_name, " SELECT src, dst FROM e")


@query(with_edges("basket", " SELECT id AS raw, row_number() OVER (ORDER BY id) - 1 AS id FROM deg"))
def id_map(spark, sf):
    return G.id_map(edges(spark, sf, "basket"))


@query(with_edges("supply", ", m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM deg) SELECT a.k AS src, b.k AS dst FROM e JOIN m a ON e.src = a.id JOIN m b ON e.dst = b.id"))
def graph_renumbered(spark, sf):
    return G.to_graph(T.supply(spark, sf))


@query(f"WITH t AS ({T.SQL['tree']}), m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM t UNION SELECT dst FROM t)) SELECT a.k AS src, b.k AS dst FROM t JOIN m a ON t.src = a.id JOIN m b ON t.dst = b.id")
def tree_renumbered(spark, sf):
    return G.renumber(T.tree(spark, sf))


@query(with_edges("basket", " SELECT id, deg FROM deg"))
def degree(spark, sf):
    return G.degrees(edges(spark, sf, "basket"))


@query(with_edges("basket", " SELECT deg, count(*)::BIGINT AS n_nodes FROM deg GROUP BY deg"))
def degree_hist(spark, sf):
    return G.degree_histogram(edges(spark, sf, "basket"))


@query(with_edges("basket", ", k AS (SELECT id FROM deg WHERE deg >= (SELECT avg(deg) FROM deg)) SELECT src, dst FROM e WHERE src IN (FROM k) AND dst IN (FROM k)"))
def induced_subgraph(spark, sf):
    e = edges(spark, sf, "basket")
    d = cut(G.degrees(e), "deg")
    return G.induced(e, d.join(F.broadcast(d.agg(F.avg("deg").alias("a")))).where("deg >= a").select("id"))  # one row


@query(f"""WITH RECURSIVE t AS ({T.SQL['tree']}), w AS (SELECT 2::BIGINT AS id, 0::BIGINT AS depth UNION ALL SELECT t.src, w.depth + 1 FROM w JOIN t ON t.dst = w.id) SELECT id, depth FROM w""")
def tree_descendants(spark, sf):
    return longs(G.descendants(T.tree(spark, sf).where("src <> dst").groupBy("src").agg(F.max("dst").alias("dst")), 2), "id", "depth")


@query()
def subtree_tree(spark, sf):
    return G.subtree(T.tree(spark, sf), 400)


_TREE_TOP = f"""WITH RECURSIVE t AS ({T.SQL['tree']}), w AS (SELECT DISTINCT dst AS id, dst AS top FROM t WHERE dst NOT IN (SELECT src FROM t) UNION ALL SELECT t.src, w.top FROM w JOIN t ON t.dst = w.id)"""


@query(_TREE_TOP + " SELECT id, min(id) OVER (PARTITION BY top) AS component FROM w")
def components(spark, sf):
    return G.components(edges(spark, sf, "tree"))


@query(_TREE_TOP + ", c AS (SELECT top, count(*) AS k, min(id) AS component FROM w GROUP BY top) SELECT component, true AS bipartite FROM c")
def bipartite_check(spark, sf):
    return G.bipartite(edges(spark, sf, "tree"))


@query(_TREE_TOP + """, d AS (SELECT id, count(*) AS deg FROM (SELECT src AS id FROM t UNION ALL SELECT dst FROM t) GROUP BY id)
SELECT (SELECT count(*) FROM w)::BIGINT AS n, (SELECT count(*) FROM t)::BIGINT AS m, (SELECT max(deg) FROM d)::BIGINT AS max_degree, (SELECT count(DISTINCT top) FROM w)::BIGINT AS components,
       (SELECT max(k) FROM (SELECT count(*) AS k FROM w GROUP BY top))::DOUBLE / (SELECT count(*) FROM w) AS giant, true AS is_tree, true AS bipartite""")
def profile(spark, sf):
    p = G.profile(edges(spark, sf, "tree"), 3)
    return spark.createDataFrame([(p["n"], p["m"], p["max_degree"], p["components"], p["giant"], p["is_tree"], p["bipartite"])], "n long, m long, max_degree long, components long, giant double, is_tree boolean, bipartite boolean")


@query(with_edges("users", " SELECT round(corr(a.deg::DOUBLE, b.deg::DOUBLE), 6) AS assortativity FROM e JOIN deg a ON e.src = a.id JOIN deg b ON e.dst = b.id"))
def assortativity(spark, sf):
    return G.assortativity(edges(spark, sf, "users")).select(F.round("assortativity", 6).alias("assortativity"))


def _pagerank_sql(rounds: int) -> str:
    s = ", n AS (SELECT count(*)::DOUBLE AS n FROM deg), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT n FROM n) AS rank FROM deg)"
    for k in range(1, rounds + 1):
        s += f", r{k} AS MATERIALIZED (SELECT e.dst AS id, 0.15::DOUBLE / (SELECT n FROM n) + 0.85::DOUBLE * sum(r.rank / d.deg) AS rank FROM e JOIN r{k - 1} r ON e.src = r.id JOIN deg d ON d.id = r.id GROUP BY e.dst)"
    return s + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query(with_edges("users", _pagerank_sql(5)))
def pagerank(spark, sf):
    return G.pagerank(edges(spark, sf, "users"), rounds=5).select("id", F.round("rank", 9).alias("rank"))


def _lp_sql(rounds: int) -> str:
    s = ", l0 AS MATERIALIZED (SELECT id, id AS label FROM deg)"
    for k in range(1, rounds + 1):
        s += f""", v{k} AS (SELECT e.src AS id, l.label, count(*) AS n FROM e JOIN l{k - 1} l ON e.dst = l.id GROUP BY ALL),
b{k} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v{k}) WHERE r = 1),
l{k} AS MATERIALIZED (SELECT l.id, CASE WHEN {below_sql('2', 'lp', str(k - 1), 'l.id')} = 0 THEN b.label ELSE l.label END AS label FROM l{k - 1} l LEFT JOIN b{k} b ON l.id = b.id)"""
    return s + f" SELECT id, label FROM l{rounds}"


@query(with_edges("users", _lp_sql(3)))
def label_propagation(spark, sf):
    return G.label_propagation(edges(spark, sf, "users"), 3)


@query(with_edges("users", ", x AS (SELECT src % 5 AS label, count(*) AS vol, sum((src % 5 <> dst % 5)::INT) AS k FROM e GROUP BY 1), t AS (SELECT sum(vol) AS a FROM x) SELECT label, round(k::DOUBLE / least(vol, a - vol), 9) AS conductance FROM x, t"))
def conductance(spark, sf):
    e = edges(spark, sf, "users")
    labels = G.nodes_of(e).select("id", (F.col("id") % 5).alias("label"))
    return G.conductance(e, labels).select("label", F.round("conductance", 9).alias("conductance"))


# distances
_LM = f", lm AS MATERIALIZED (SELECT id FROM (SELECT id FROM deg ORDER BY deg DESC, id LIMIT 4) UNION ALL SELECT id FROM (SELECT id FROM deg WHERE id NOT IN (SELECT id FROM deg ORDER BY deg DESC, id LIMIT 4) ORDER BY md5(concat_ws('|', '42', 'landmark', id::VARCHAR)), id LIMIT 4))"


def _bfs_sql(sources: str, bound: int = 12) -> str:
    s = f", f0 AS MATERIALIZED (SELECT id AS source, id AS node FROM {sources}), s0 AS (SELECT source, node, 0::BIGINT AS dist FROM f0)"
    for k in range(1, bound + 1):
        seen = f"s{k - 1}"
        s += f", f{k} AS MATERIALIZED (SELECT DISTINCT f.source, e.dst AS node FROM f{k - 1} f JOIN e ON e.src = f.node WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.source = f.source AND x.node = e.dst)), s{k} AS MATERIALIZED (SELECT * FROM {seen} UNION ALL SELECT source, node, {k} FROM f{k})"
    return s + f", bfs AS (SELECT * FROM s{bound})"


@query(with_edges("basket", _LM + " SELECT id FROM lm"))
def landmark_pick(spark, sf):
    return D.pick_landmarks(edges(spark, sf, "basket"), 8)


@query(with_edges("basket", _LM + _bfs_sql("lm", 8) + " SELECT source AS landmark, node, dist FROM bfs"))
def landmark_table(spark, sf):
    e = cut(edges(spark, sf, "basket"), "edges")
    return longs(D.landmark_table(e, cut(D.pick_landmarks(e, 8), "lm")), "landmark", "node", "dist")


@query(with_edges("basket", _LM + _bfs_sql("lm", 8) + ", p AS (SELECT id AS u, lead(id) OVER (ORDER BY id) AS v FROM deg) SELECT p.u, p.v, least(greatest(min(a.dist + b.dist), 1), 32)::DOUBLE AS est FROM p JOIN bfs a ON a.node = p.u JOIN bfs b ON b.node = p.v AND a.source = b.source GROUP BY ALL"))
def landmark_pair_distance(spark, sf):
    e = cut(edges(spark, sf, "basket"), "edges")
    return D.landmark_distance(D.landmark_table(e, cut(D.pick_landmarks(e, 8), "lm")), _next_pairs(e), 32, 100.0)


def _next_pairs(e: DataFrame) -> DataFrame:
    """u, v: each node and the next by id."""
    ids = cut(G.id_map(e), "ids")
    return ids.select(F.col("raw").alias("u"), "id").join(ids.select(F.col("raw").alias("v"), (F.col("id") - 1).alias("id")), "id").select("u", "v")


@query(with_edges("supply", _LM + _bfs_sql("lm", 8) + " SELECT source, node, dist FROM bfs"))
def bfs_hops(spark, sf):
    e = cut(edges(spark, sf, "supply"), "edges")
    return longs(D.bfs(e, cut(D.pick_landmarks(e, 8), "lm")), "source", "node", "dist")


@query(with_edges("users", _bfs_sql("deg", 8) + " SELECT dist AS h, count(*)::BIGINT AS n FROM bfs WHERE dist > 0 GROUP BY 1"))
def hop_histogram(spark, sf):
    return longs(D.all_shells(cut(edges(spark, sf, "users"), "edges")).groupBy("h").agg(F.sum("n").alias("n")), "h", "n")


@query(with_edges("users", _bfs_sql("deg", 2) + " SELECT source AS u, node AS v, dist AS h FROM bfs WHERE dist > 0"))
def bounded_hops(spark, sf):
    return longs(D.all_pairs(cut(edges(spark, sf, "users"), "edges"), 2), "u", "v", "h")


@query(with_edges("users", _bfs_sql("deg", 8) + " SELECT source AS u, dist AS h, count(*)::BIGINT AS n FROM bfs WHERE dist > 0 GROUP BY 1, 2"))
def shell_counts(spark, sf):
    return longs(D.all_shells(cut(edges(spark, sf, "users"), "edges")), "u", "h", "n")


@query(with_edges("users", _bfs_sql("deg", 8) + " SELECT a.id AS u, b.id AS v, coalesce(dist, (SELECT count(*) FROM deg))::BIGINT AS h FROM deg a CROSS JOIN deg b LEFT JOIN bfs ON source = a.id AND node = b.id"))
def all_pairs_hop_fill(spark, sf):
    return longs(D.hop_fill(cut(edges(spark, sf, "users"), "edges")), "u", "v", "h")


@query(with_edges("users", _bfs_sql("deg", 8) + ", p AS (SELECT id AS u, lead(id) OVER (ORDER BY id) AS v FROM deg) SELECT u, v, dist::DOUBLE AS hops FROM p JOIN bfs ON source = u AND node = v"))
def hop_distance(spark, sf):
    e = cut(edges(spark, sf, "users"), "edges")
    return D.hop_distance(e, _next_pairs(e))


def _relax_sql(rounds: int) -> str:
    s = ", ew AS (SELECT src, dst, (1 + abs(src - dst) % 5)::DOUBLE AS w FROM e), d0 AS MATERIALIZED (SELECT id AS source, id AS node, 0.0::DOUBLE AS dist FROM lm)"
    for k in range(1, rounds + 1):
        s += f", d{k} AS MATERIALIZED (SELECT source, node, min(dist) AS dist FROM (SELECT * FROM d{k - 1} UNION ALL SELECT d.source, ew.dst, d.dist + ew.w FROM d{k - 1} d JOIN ew ON ew.src = d.node) GROUP BY ALL)"
    return s + f" SELECT source, node, dist FROM d{rounds}"


@query(with_edges("users", _LM + _relax_sql(10)))
def weighted_shortest_path(spark, sf):
    e = cut(edges(spark, sf, "users").withColumn("w", (1 + F.abs(F.col("src") - F.col("dst")) % 5).cast("double")), "edges")
    return D.weighted_paths(e, cut(D.pick_landmarks(e.select("src", "dst"), 8), "lm"))


_BFS_KEY = "md5(concat_ws('|', '42', 'rows', source::VARCHAR, node::VARCHAR))"


@query(with_edges("users", _bfs_sql("deg", 8) + f", a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_BFS_KEY}, node) AS r FROM bfs), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r) AS k FROM a WHERE r <= 10 AND dist > 0) SELECT source AS u, node AS v, dist AS hops FROM b WHERE k <= 5"))
def bfs_rows_pairs(spark, sf):
    e = cut(edges(spark, sf, "users"), "edges")
    return longs(D.bfs_rows(e, G.nodes_of(e), 5), "u", "v", "hops")


# walks
def starts_sql(n: int) -> str:
    return f", st AS (SELECT (id * {n} + r)::BIGINT AS walk_id, id AS start FROM deg, (SELECT unnest(range({n})) AS r))"


ADJ = ", adj AS MATERIALIZED (SELECT src, list(dst ORDER BY dst) AS nb, count(*) AS k FROM e GROUP BY src)"


def walk_sql(n: int, length: int) -> str:
    s = ADJ + starts_sql(n) + ", w0 AS MATERIALIZED (SELECT walk_id, start, start AS node, [start] AS path FROM st)"
    for t in range(1, length):
        s += f", w{t} AS MATERIALIZED (SELECT walk_id, start, x AS node, list_append(path, x) AS path FROM (SELECT w.*, coalesce(a.nb[1 + {below_sql('a.k', 'walk', 'w.walk_id', str(t))}], w.node) AS x FROM w{t - 1} w LEFT JOIN adj a ON a.src = w.node))"
    return s + f", walks AS (SELECT walk_id, start, path FROM w{length - 1})"


WALKS, LENGTH = 2, 6


def told(walks: DataFrame) -> DataFrame:
    return walks.select("walk_id", "start", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


def walks(spark, sf, name="basket") -> DataFrame:
    e = cut(edges(spark, sf, name), "edges")
    return cut(W.uniform_walks(e, W.starts_of(G.nodes_of(e), WALKS), LENGTH), "walks")


@query(with_edges("basket", walk_sql(WALKS, LENGTH) + " SELECT walk_id, start, array_to_string(path, ' ') AS path FROM walks"))
def uniform_walk(spark, sf):
    return told(walks(spark, sf))


@query(SQL["uniform_walk"])
def uniform_walk_blocks(spark, sf):
    e = cut(edges(spark, sf, "basket"), "edges")
    return told(W.block_walks(e, W.starts_of(G.nodes_of(e), WALKS), LENGTH))


def _node2vec_sql(length: int, p: float, q: float, tries: int) -> str:
    top = max(1.0, 1 / p, 1 / q)
    s = ADJ + starts_sql(1) + ", w0 AS MATERIALIZED (SELECT walk_id, start, start AS node, [start] AS path, NULL::BIGINT AS prev FROM st)"
    for t in range(1, length):
        s += f""", c{t} AS (SELECT w.*, y.try, a.nb[1 + {below_sql('a.k', 'walk2', 'w.walk_id', str(t), 'y.try')}] AS x FROM w{t - 1} w JOIN adj a ON a.src = w.node, (SELECT unnest(range({tries})) AS try) y WHERE w.prev IS NOT NULL OR y.try = 0),
k{t} AS (SELECT *, CASE WHEN {u01_sql('accept', 'walk_id', str(t), 'try')} * {top} < (CASE WHEN prev IS NULL THEN {top} WHEN x = prev THEN {1 / p} WHEN EXISTS (SELECT 1 FROM e WHERE e.src = c.prev AND e.dst = c.x) THEN 1.0 ELSE {1 / q} END) THEN try ELSE {2 * tries} - try END AS r FROM c{t} c),
w{t} AS MATERIALIZED (SELECT walk_id, start, x AS node, list_append(path, x) AS path, node AS prev FROM (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY r) AS o FROM k{t}) WHERE o = 1)"""
    return s + f" SELECT walk_id, start, array_to_string(path, ' ') AS path FROM w{length - 1}"


@query(with_edges("users", _node2vec_sql(4, 0.5, 2.0, 6)))
def node2vec_walk(spark, sf):
    e = cut(edges(spark, sf, "users"), "edges")
    return told(W.node2vec_walks(e, W.starts_of(G.nodes_of(e), 1), 4, 0.5, 2.0, 6))


def _race_sql(length: int, p: float, q: float) -> str:
    s = starts_sql(1) + ", w0 AS MATERIALIZED (SELECT walk_id, start, start AS node, [start] AS path, NULL::BIGINT AS prev FROM st)"
    for t in range(1, length):
        s += f""", k{t} AS (SELECT w.*, e.dst AS x, -ln(1.0 - {u01_sql('race', 'w.walk_id', str(t), 'e.dst')}) / (CASE WHEN prev IS NULL THEN 1.0 WHEN e.dst = prev THEN {1 / p} WHEN EXISTS (SELECT 1 FROM e b WHERE b.src = w.prev AND b.dst = e.dst) THEN 1.0 ELSE {1 / q} END) AS r FROM w{t - 1} w JOIN e ON e.src = w.node),
w{t} AS MATERIALIZED (SELECT walk_id, start, x AS node, list_append(path, x) AS path, node AS prev FROM (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY r, x) AS o FROM k{t}) WHERE o = 1)"""
    return s + f" SELECT walk_id, start, array_to_string(path, ' ') AS path FROM w{length - 1}"


@query(with_edges("users", _race_sql(4, 0.5, 2.0)))
def second_order_walk(spark, sf):
    e = cut(edges(spark, sf, "users"), "edges")
    return told(W.weighted_second_order(e, W.starts_of(G.nodes_of(e), 1), 4, 0.5, 2.0))


