"""Queries on readers, writers, records and protocols: what is written in a format is read again and held against SQL."""

from __future__ import annotations

import dataclasses
import io
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import u01_sql
from ..operators import baselines, build, engine, laws, optim
from ..operators import graph as G
from ..operators import paths as D
from ..operators import walks as W
from ..sources import files as S
from ..sources import store
from ..sources import tables as T
from . import cli, protocols, report, tasks
from .q_graph import edges, with_edges
from .state import cut, folder

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def place(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """A folder with the column ``value`` as lines."""
    path = place(spark, name)
    lines.select("value").write.text(path)
    return path


def both(df: DataFrame) -> DataFrame:
    return df.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def lines_of(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string")


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(names: str, *data: tuple) -> str:
    """A fixed table in SQL."""
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else f"{x}::BIGINT"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in data)}) AS t({names})"


# graph formats
@query(f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({T.SQL['supply']})")
def read_citation(spark, sf):
    e = T.supply(spark, sf).distinct().select(F.format_string("%d \t%d ", "src", "dst").alias("value"))
    return both(S.read_edges(spark, "citation", written(spark, e.union(lines_of(spark, "", "  ")), "citation")))


@query(f"SELECT 'p' || src AS src, 's-' || dst AS dst FROM ({T.SQL['supply']})")
def read_named(spark, sf):
    e = T.supply(spark, sf).distinct().select(F.format_string("p%d s-%d", "src", "dst").alias("value"))
    return S.read_edges(spark, "named", written(spark, e, "named"))


@query(f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({T.SQL['supply']})")
def read_papers(spark, sf):
    e = T.supply(spark, sf).distinct().select(F.format_string("7\tpaper:%d\t|\tpaper:%d", "src", "dst").alias("value"))
    return both(S.read_edges(spark, "papers", written(spark, lines_of(spark, "DIRECTED\tcites", "NO_FEATURES").union(e), "papers")))


@query(f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({T.SQL['supply']})")
def read_tabbed(spark, sf):
    e = T.supply(spark, sf).distinct().select(F.format_string("%d\t%d", "src", "dst").alias("value"))
    return both(S.read_edges(spark, "tabbed", written(spark, lines_of(spark, "# From\tTo").union(e), "tabbed")))


@query(f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({T.SQL['tree']})")
def read_nouns(spark, sf):
    """One or two words (a hexadecimal count), a pointer to the parent and others that aren't to be read."""
    two = F.col("src") % 2 == 0
    head = F.concat(F.format_string("%08d 03 n ", "src"), F.when(two, F.lit("02 a 0 b 1 ")).otherwise(F.lit("01 a 0 ")))
    kind = F.when(F.col("src") % 3 == 0, F.lit("@i")).otherwise(F.lit("@"))
    text = F.concat(head, F.lit("003 ~ 00000001 n 0000 "), kind, F.format_string(" %08d n 0000 ", "dst"), F.lit("%p 00000002 n 0000 | gloss @ 00000009 n 0000"))
    return both(S.read_edges(spark, "nouns", written(spark, lines_of(spark, "  1 licence @ 00000003 n").union(T.tree(spark, sf).select(text.alias("value"))), "nouns")))


@query(f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({T.SQL['tree']})")
def read_taxonomy(spark, sf):
    e = T.tree(spark, sf).select(F.format_string("%d\t|\t%d\t|\trank\t|\t", "src", "dst").alias("value"))
    return both(S.read_edges(spark, "taxonomy", written(spark, e.union(lines_of(spark, "1\t|\t1\t|\tno rank\t|\t")), "taxonomy")))


@query(f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({T.SQL['users']})")
def read_edge_list(spark, sf):
    e = T.users(spark, sf).where("src <> dst").distinct().select(F.format_string("%d, %d ,0.5", "src", "dst").alias("value"))
    return both(S.edge_list(spark, written(spark, e, "list")))


@query(f"WITH {T.edges_sql('users')} SELECT src - (SELECT min(src) FROM e) AS src, dst - (SELECT min(src) FROM e) AS dst FROM e WHERE src > dst")
def matrix_market_round(spark, sf):
    e = cut(edges(spark, sf, "users"), "edges")
    low, top = e.agg(F.min("src"), F.max("src")).first()
    path = place(spark, "mtx")
    S.write_matrix_market(e.select((F.col("src") - low).alias("src"), (F.col("dst") - low).alias("dst")), int(top - low + 1), path)
    return both(S.matrix_market(spark, path))


def _small(spark: SparkSession, sf: str) -> list[tuple[int, int]]:
    """Nations and regions: 25 edges whatever the size of the tables."""
    return sorted((r.n_nationkey, 25 + r.n_regionkey) for r in T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect())


_SMALL = "SELECT n_nationkey::BIGINT AS src, (25 + n_regionkey)::BIGINT AS dst FROM nation"


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, src, dst FROM ({_SMALL})" for k in ("csr", "dense", "edges")))
def read_npz_graph(spark, sf):
    e = _small(spark, sf)
    dense = np.zeros((30, 30))
    dense[tuple(zip(*e))] = 1
    kinds = {"edges": {"edges": np.array(e)}, "dense": {"A": dense}, "csr": {"indptr": np.concatenate([[0], np.cumsum(dense.sum(1).astype(int))]), "indices": np.argwhere(dense)[:, 1]}}
    out = None
    for kind, arrays in kinds.items():
        path, data = f"{place(spark, kind)}.npz", io.BytesIO()
        np.savez(data, **arrays)
        S.put_bytes(spark, path, data.getvalue())
        one = S.npz_graph(spark, path).select(F.lit(kind).alias("kind"), "src", "dst")
        out = one if out is None else out.union(one)
    return out


@query(with_edges("supply", " SELECT (SELECT count(*) FROM deg)::BIGINT AS n, (count(*) // 2)::BIGINT AS n_edges, round(count(*)::DOUBLE / (SELECT count(*) FROM deg), 6) AS avg_degree FROM e"))
def load_graph_facts(spark, sf):
    """A file by its ending, loaded symmetric."""
    e = T.supply(spark, sf).distinct().select(F.format_string("%d,%d", "src", "dst").alias("value"))
    facts = S.load_graph(spark, written(spark, e, "graph.csv"))[1]
    return rows(spark, [(facts["n"], facts["n_edges"], round(facts["avg_degree"], 6))], "n long, n_edges long, avg_degree double")


@query(f"WITH g AS (SELECT src, dst FROM ({T.SQL['tree']})) SELECT src, dst FROM g UNION SELECT dst, src FROM g")
def load_registry_name(spark, sf):
    """A graph by its bare name, from a data folder."""
    data = place(spark, "data")
    e = T.tree(spark, sf).select(F.format_string("%d\t|\t%d\t|\t", "src", "dst").alias("value"))
    e.write.text(f"{data}/{S.REGISTRY['ncbi_taxonomy'][1]}")
    return both(S.load_graph(spark, "ncbi_taxonomy", data=data)[0])


@query(with_edges("basket", ", m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM deg) SELECT m.k AS src, (row_number() OVER (PARTITION BY e.src ORDER BY e.dst) - 1)::BIGINT AS k, n.k AS dst FROM e JOIN m ON e.src = m.id JOIN m n ON e.dst = n.id"))
def csr_rows(spark, sf):
    """Each node's neighbours in order, numbered: the rows of the sparse matrix."""
    return G.indexed(G.to_graph(T.basket(spark, sf))).select("src", "k", "dst")


@query(with_edges("supply", " SELECT id, coalesce(deg, 0)::BIGINT AS deg FROM (SELECT p_partkey * 2 AS id FROM part UNION SELECT s_suppkey * 2 + 1 FROM supplier UNION SELECT -1) LEFT JOIN deg USING (id)"))
def isolated_nodes(spark, sf):
    """Nodes without an edge keep their place: all parts and suppliers, and one that nothing names."""
    parts = T.table(spark, sf, "part").select((F.col("p_partkey") * 2).cast("long").alias("id"))
    suppliers = T.table(spark, sf, "supplier").select((F.col("s_suppkey") * 2 + 1).cast("long").alias("id"))
    nodes, none = G.base_graph(parts.union(suppliers).union(spark.range(1).select(F.lit(-1).cast("long").alias("id"))))
    e = edges(spark, sf, "supply")
    return G.degrees(none.union(e), nodes)


@query(values("same, other, loops", (True, False, True)))
def graph_hash_order(spark, sf):
    """The key of an edge set doesn't depend on order, and tells other sets apart."""
    e = cut(edges(spark, sf, "users"), "edges")
    h = S.graph_hash(e)
    return rows(spark, [(h == S.graph_hash(e.orderBy(F.desc("dst")).repartition(7)), h == S.graph_hash(e.where("src <> 0 or dst > 5").limit(max(1, e.count() - 1))), h == S.graph_hash(e.union(e.where("false"))))], "same boolean, other boolean, loops boolean")


@query(with_edges("users", " SELECT (SELECT count(*) FROM deg)::BIGINT AS n, (SELECT max(deg) FROM deg)::BIGINT AS top, true AS missing"))
def profile_cache(spark, sf):
    """Facts written under the graph's key and found by it."""
    e, at = cut(edges(spark, sf, "users"), "edges"), place(spark, "profiles")
    missing = S.read_profile(e, at) is None
    n, top = G.degrees(e).agg(F.count(F.lit(1)), F.max("deg")).first()
    S.write_profile(e, {"n": n, "top": top}, at)
    got = S.read_profile(e, at)
    return rows(spark, [(got["n"], got["top"], missing)], "n long, top long, missing boolean")


@query("SELECT count(*)::BIGINT AS n_dim, 0.5::DOUBLE AS lr, 'adam' AS rule FROM region")
def read_context_file(spark, sf):
    path = f"{place(spark, 'context')}.json"
    S.put_bytes(spark, path, json.dumps({"n_dim": T.table(spark, sf, "region").count(), "lr": 0.5, "rule": "adam"}).encode())
    c = report.Context(**S.read_context(path))
    return rows(spark, [(c.n_dim, c.lr, c.rule)], "n_dim long, lr double, rule string")


# embedding formats
_EMB = "SELECT vec_id::BIGINT AS id, round(embedding[1]::DOUBLE, 5) AS x0, round(embedding[64]::DOUBLE, 5) AS x63 FROM embeddings"


def _ends(z: DataFrame) -> DataFrame:
    return z.select(F.col("id").cast("long").alias("id"), F.round(F.col("vec")[0].cast("double"), 5).alias("x0"), F.round(F.col("vec")[63].cast("double"), 5).alias("x63"))


@query(_EMB)
def read_csv_embedding(spark, sf):
    z = T.vectors(spark, sf)
    path = f"{place(spark, 'z')}.csv"
    z.select(F.concat_ws(",", F.col("id").cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")).alias("value")).write.text(path)
    return _ends(S.load_embedding(spark, path)[0])


def _text(spark: SparkSession, z: DataFrame, base: int) -> str:
    body = z.select(F.concat_ws(" ", (F.col("id") + base).cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    path, count = place(spark, "vectors"), z.count()
    lines_of(spark, f"{count} 64").withColumn("k", F.lit(0)).union(body.withColumn("k", F.lit(1))).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return path


@query(f"{_EMB} UNION ALL SELECT -1, 0.0, 0.0")
def read_w2v_embedding(spark, sf):
    """Text vectors; a node without one gets zeros."""
    z = T.vectors(spark, sf)
    return _ends(S.load_embedding(spark, _text(spark, z, 0), z.select("id").union(spark.range(1).select(F.lit(-1).cast("long").alias("id"))))[0])


@query(_EMB)
def read_embd_embedding(spark, sf):
    """The same with ids from 1."""
    z = T.vectors(spark, sf)
    return _ends(S.embedding_embd(spark, _text(spark, z, 1), z.count(), 64))


@query("SELECT count(*)::BIGINT AS n, 64::BIGINT AS n_dim, sum((list_max(list_transform(embedding, lambda x: abs(x))) = 0)::INT)::BIGINT AS zero_rows FROM embeddings")
def load_embedding_facts(spark, sf):
    facts = S.load_embedding(spark, T.vectors(spark, sf).select("id", "vec"))[1]
    return rows(spark, [(facts["n"], facts["n_dim"], facts["zero_rows"])], "n long, n_dim long, zero_rows long")


@query("SELECT 0::BIGINT AS id, 'npz' AS kind, count(*)::DOUBLE AS a, 1.0::DOUBLE AS b FROM nation UNION ALL SELECT 0, 'npy', count(*), 2.0 FROM nation")
def read_npz_embedding(spark, sf):
    n, out = T.table(spark, sf, "nation").count(), None
    for kind, save, k in (("npz", lambda f, a: np.savez(f, Z=a), 1.0), ("npy", np.save, 2.0)):
        data, path = io.BytesIO(), f"{place(spark, 'z')}.{kind}"
        save(data, np.array([[float(n), k]]))
        S.put_bytes(spark, path, data.getvalue())
        one = S.load_embedding(spark, path)[0].select("id", F.lit(kind).alias("kind"), F.col("vec")[0].cast("double").alias("a"), F.col("vec")[1].cast("double").alias("b"))
        out = one if out is None else out.union(one)
    return out


@query(with_edges("users", " SELECT id AS start, 3::BIGINT AS n_walks, 12::BIGINT AS n_nodes, 0::BIGINT AS jumps FROM deg"))
def write_walks_text(spark, sf):
    """Walks as lines of text, read again: as many from each node as asked for, and each step an edge."""
    e = cut(edges(spark, sf, "users"), "edges")
    path = place(spark, "walks")
    S.write_walks(W.graph_walk(e, 3, 4), path)
    nodes = F.transform(F.split("value", " "), lambda x: x.cast("long"))
    w = spark.read.text(path).select(F.xxhash64("value", F.monotonically_increasing_id()).alias("w"), nodes.alias("p"))
    steps = w.select("w", F.col("p")[0].alias("start"), F.size("p").alias("len"), F.explode(F.arrays_zip(F.expr("slice(p, 1, size(p) - 1)").alias("src"), F.expr("slice(p, 2, size(p) - 1)").alias("dst"))).alias("s")).select("w", "start", "len", "s.src", "s.dst")
    bad = steps.join(e.withColumn("ok", F.lit(1)), ["src", "dst"], "left").groupBy("start").agg(F.countDistinct("w").alias("n_walks"), F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("jumps"))
    sizes = w.groupBy(F.col("p")[0].alias("start")).agg(F.sum(F.size("p")).cast("long").alias("n_nodes"))
    return bad.join(sizes, "start").select("start", F.col("n_walks").cast("long").alias("n_walks"), "n_nodes", F.col("jumps").cast("long").alias("jumps"))


_ID = "(SELECT unnest(range(300)) AS id)"


def _surface(f):
    return lambda spark, sf: f(spark, 300).select("id", *[F.round(F.col("vec")[i], 5).alias(f"x{i}") for i in range(3)], F.round("target", 5).alias("target"))


def _surface_sql(t: str, x: tuple[str, str, str]) -> str:
    return f"WITH r AS (SELECT id, {t} AS t FROM {_ID}) SELECT id::BIGINT AS id, {', '.join(f'round({v}, 5) AS x{i}' for i, v in enumerate(x))}, round(t, 5) AS target FROM r"


Q["swiss_roll"] = _surface(lambda spark, n: S.swiss_roll(spark, n, 0))
SQL["swiss_roll"] = _surface_sql(f"4.71238898038469 * (1 + 2 * {u01_sql('roll', 'id', '0', seed=0)})", ("t * cos(t)", f"21 * {u01_sql('roll', 'id', '1', seed=0)}", "t * sin(t)"))
Q["s_curve"] = _surface(lambda spark, n: S.s_curve(spark, n, 0))
SQL["s_curve"] = _surface_sql(f"9.42477796076938 * ({u01_sql('curve', 'id', '0', seed=0)} - 0.5)", ("sin(t)", f"2 * {u01_sql('curve', 'id', '1', seed=0)}", "sign(t) * (cos(t) - 1)"))
Q["closed_curve"] = _surface(lambda spark, n: S.closed_curve(spark, n, 0))
_WAVE = lambda p: " + ".join(f"cos(t * {k} + {p * k}) / {k}" for k in range(1, 5))
SQL["closed_curve"] = _surface_sql(f"6.283185307179586 * {u01_sql('curve3', 'id', seed=0)}", tuple(f"({_WAVE(p)})" for p in (0.0, 1.0, 2.0)))


@query("SELECT count(*)::BIGINT * 4 AS n, (3 + 3 * (count(*) * 4 - 4))::BIGINT AS n_edges, 3::BIGINT AS least, 0::BIGINT AS loops FROM nation")
def preferential_graph(spark, sf):
    """100 nodes: a path on 4, then 3 edges for each new node."""
    n = T.table(spark, sf, "nation").count() * 4
    e = S.preferential(spark, n, 3)
    new = e.where("src > 3").groupBy("src").agg(F.countDistinct("dst").alias("k"))
    return e.agg(F.lit(n).cast("long").alias("n"), F.count(F.lit(1)).alias("n_edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops")).join(F.broadcast(new.agg(F.min("k").alias("least")))).select("n", "n_edges", "least", "loops")  # one row


# strategies, laws, rules, schedules
_POINTS = 60


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return T.vectors(spark, sf).where(F.col("id") < _POINTS).select("id", "vec")


_NEAR = f"""WITH z AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < {_POINTS}),
p AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS d FROM z a JOIN z b ON a.id <> b.id),
k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM p),
e AS (SELECT src, dst FROM k WHERE r <= 5 UNION SELECT dst, src FROM k WHERE r <= 5)"""


@query(_NEAR + " SELECT e.src::BIGINT AS src, e.dst::BIGINT AS dst, round(p.d, 5) AS w FROM e JOIN p ON p.src = e.src AND p.dst = e.dst")
def make_graph_knn(spark, sf):
    """A named strategy, symmetric and with lengths."""
    return build.make_graph(_points(spark, sf), "knn", weighted=True).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("w", 5).alias("w"))


@query(values("name", ("knn",), ("mst",), ("mst_k_minimum",), ("union_mst_knn",)))
def strategy_names(spark, sf):
    return rows(spark, [(n,) for n in build.strategies()], "name string")


@query(values("law, plane", ("edge_constants", "c1"), ("edge_constants", "c2"), ("hop", "h"), ("hop2", "h"), ("hop_all", "h"), ("hop_all_freq", "freq"), ("hop_all_freq", "h"), ("hop_min", "deg_le"), ("hop_min", "h"), ("linear", "freq"), ("linear", "h"), ("linear_fused", "w"), ("linear_undivided", "freq"), ("linear_undivided", "h"), ("shell", "h"), ("shell", "shell_c"), ("shell_v2", "h"), ("shell_v2", "shell_c")))
def law_planes(spark, sf):
    return rows(spark, [(n, p) for n in laws.LAWS for p in laws.planes_of(n)], "law string, plane string")


@query(values("rule, arrays", ("adam", 2), ("lbfgs", 8), ("momentum", 1), ("nesterov", 1), ("plain", 0), ("sgd", 0), ("swing", 1), ("velocity", 1)))
def rule_state(spark, sf):
    """How many vectors each update rule keeps beside a row's own."""
    return rows(spark, [(n, optim.state_arrays(n)) for n in [*optim.RULES, "lbfgs"]], "rule string, arrays long")


@query("""WITH e AS (SELECT unnest(range(21))::BIGINT AS epoch) SELECT epoch, 1.0::DOUBLE AS constant, round(greatest(0.0, 1 - epoch / 20.0), 9) AS linear, round(0.5 * (1 + cos(pi() * epoch / 20.0)), 9) AS cosine,
round(greatest(0.0, 1 - epoch / 20.0) * sin(pi() / 4 * epoch), 9) + 0.0 AS linear_sine, round(1 / (1 + exp((epoch - 10.0) / 2.0)), 9) AS sigmoid, round(exp(-10.0 * epoch / 20.0), 9) AS exponential FROM e""")
def decay_curves(spark, sf):
    names = list(engine.DECAYS)
    data = [(k, *(round(float(engine.DECAYS[n](k, 20)), 9) + 0.0 for n in names)) for k in range(21)]
    return rows(spark, data, "epoch long, " + ", ".join(f"{n} double" for n in names))


@query(values("event, n", ("epoch_begin", 2), ("epoch_end", 2), ("train_begin", 1), ("train_end", 1)))
def loop_events(spark, sf):
    """What hooks of the epoch loop are told in two epochs; an object that is no hook raises."""
    seen: dict[str, int] = {}

    class Count(engine.Callback):
        pass

    for event in ("train_begin", "train_end", "epoch_begin", "epoch_end"):
        setattr(Count, event, lambda self, event=event, **kw: seen.__setitem__(event, seen.get(event, 0) + 1))
    e = both(rows(spark, _small(spark, sf), "src long, dst long"))
    pairs = G.symmetric(e).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("h"), F.lit(1.0).alias("freq"))
    loop = engine.Relaxation("hop", 2)
    loop.attach(Count())
    loop.embed(pairs, 2)
    return rows(spark, sorted(seen.items()), "event string, n long")


@query("SELECT n_nationkey::BIGINT AS id, 2::BIGINT AS d FROM nation UNION ALL SELECT (25 + r_regionkey)::BIGINT, 2 FROM region")
def embedding_rows(spark, sf):
    """One vector a node, by the loop after its rule was changed."""
    e = both(rows(spark, _small(spark, sf), "src long, dst long"))
    pairs = G.symmetric(e).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("h"), F.lit(1.0).alias("freq"))
    loop = engine.Relaxation("hop", 2)
    loop.set_rule("momentum", 0.1)
    z = loop.embed(pairs, 1)
    return z.select(F.col("id").cast("long").alias("id"), F.size("vec").cast("long").alias("d"))


@query("SELECT n_nationkey::BIGINT AS u, (25 + n_regionkey)::BIGINT AS v, 'auto' AS backend, 1.0::DOUBLE AS hops FROM nation UNION ALL SELECT n_nationkey, 25 + n_regionkey, 'bfs', 1.0 FROM nation UNION ALL SELECT n_nationkey, 25 + n_regionkey, 'landmark', 1.0 FROM nation")
def hop_backends(spark, sf):
    """All backends agree where a landmark is an end of each pair: there are more landmarks than nodes."""
    e = cut(G.symmetric(rows(spark, _small(spark, sf), "src long, dst long")), "edges")
    pairs = rows(spark, _small(spark, sf), "u long, v long")
    out = None
    for backend in ("auto", "bfs", "landmark"):
        one = D.hop_distance(e, pairs, backend).select("u", "v", F.lit(backend).alias("backend"), "hops")
        out = one if out is None else out.union(one)
    return out


# records, protocols, command line
def _flat(name: str, part: str, cfg) -> list[tuple[str, str, str, str]]:
    return [(name, part, f.name, json.dumps(getattr(cfg, f.name))) for f in dataclasses.fields(cfg)]


#: What the protocols say of their two tasks, where it isn't the default.
_CHANGED = (
    ("citation", "dist_approx", "hidden", "[128, 64]"), ("citation", "dist_approx", "min_leaf", "1"), ("citation", "dist_approx", "n_estimators", "200"), ("citation", "dist_approx", "n_pairs", "2000"), ("citation", "link_prediction", "neg_draw", '"far_pairs"'),
    ("large", "dist_approx", "hops", '"bfs"'), ("large", "dist_approx", "n_sources", "200"), ("large", "link_prediction", "max_pairs", "80000"), ("large", "link_prediction", "n_estimators", "100"), ("large", "link_prediction", "pos_draw", '"always"'),
    ("other", "link_prediction", "max_pairs", "80000"), ("other", "link_prediction", "n_estimators", "100"),
    *((p, "dist_approx", *x) for p, own in (("shell_distance", ()), ("shell_vector", (("feature", '"vector"'),))) for x in (*own, ("early_stopping", "false"), ("hidden", "[256, 128]"), ("hops", '"bfs"'), ("min_leaf", "1"), ("n_sources", "200"), ("pair_draw", '"bfs_rows"'))),
    ("shell_distance", "link_prediction", "neg_draw", '"far_pairs"'), ("shell_vector", "link_prediction", "neg_draw", '"far_pairs"'),
)


@query(values("protocol, task, setting, value", *_CHANGED))
def protocol_settings(spark, sf):
    """Settings of link prediction and distance approximation that differ from the default protocol's."""
    found = []
    for name in protocols.PROTOCOLS:
        for part, cfg, base in zip(("link_prediction", "dist_approx"), protocols.get(name), protocols.get("default"), strict=True):
            found += [x for x, y in zip(_flat(name, part, cfg), _flat(name, part, base), strict=True) if x[3] != y[3]]
    return rows(spark, found, "protocol string, task string, setting string, value string")


@query(values("metric, floor", ("accuracy", 0.015), ("auc", 0.0075), ("nmi", 0.003), ("unknown", 0.03)))
def noise_floors(spark, sf):
    f = protocols.Floor()
    return rows(spark, [(m, round(f.of(m, v), 9)) for m, v in (("accuracy", 1.0), ("auc", 0.5), ("nmi", -0.2), ("unknown", 2.0))], "metric string, floor double")


@query(values("a, changed, pairs, bad", (30, True, 80000, True)))
def settings_override(spark, sf):
    """Settings given by name; what isn't given stays, an unknown name raises."""
    cfg, changed = protocols.override(protocols.get("other")[0], n_estimators=30, max_pairs=None)
    try:
        bad = not protocols.override(cfg, no_such=1)
    except TypeError:
        bad = True
    return rows(spark, [(cfg.n_estimators, changed, cfg.max_pairs, bad)], "a long, changed boolean, pairs long, bad boolean")


@query(values("rule, gain, effective_lr, regime, warned", ("adam", None, None, "fit", False), ("momentum", 10.0, 5.0, "low", True), ("plain", 1.0, 0.5, "high", False), ("sgd", 0.5, 0.25, None, False)))
def context_checks(spark, sf):
    """Gain of each rule on a steady force, the effective rate and the regime of the dimension."""
    out = []
    for rule, n_dim, cls in (("plain", 200, "H"), ("momentum", 8, "H"), ("sgd", 8, None), ("adam", 16, "S")):
        r = report.validate(report.Context(rule=rule, lr=0.5, n_dim=n_dim), n_dim, cls)
        out.append((rule, None if r["gain"] is None else round(r["gain"], 9), None if r["effective_lr"] is None else round(r["effective_lr"], 9), r["regime"], bool(r["warnings"])))
    return rows(spark, out, "rule string, gain double, effective_lr double, regime string, warned boolean")


@query(f"WITH {T.edges_sql('users')} SELECT 'task' AS task, 'a' AS score, count(*)::DOUBLE AS value FROM e UNION ALL SELECT 'task', 'b.c', 0.25 UNION ALL SELECT 'task', 'b.d', NULL")
def report_file(spark, sf):
    """A report written, read again and its scores flattened; what isn't finite becomes null."""
    n = edges(spark, sf, "users").count()
    made = report.Report({}, {}, [report.TaskResult("task", {"n": np.int64(3)}, {"a": float(n), "b": {"c": np.float64(0.25), "d": float("nan")}})], tags=report.tags(["k=v"]))
    path = f"{place(spark, 'report')}.json"
    S.put_bytes(spark, path, json.dumps(made.record()).encode())
    record = json.loads(S.get_bytes(spark, path))
    return rows(spark, [(r["task"], k, v) for r in record["results"] for k, v in report.flatten(r["scores"]).items()], "task string, score string, value double")


@query(values("line", ("default* | t | a | 0.5000",), ("default* | t | b | -",), ("default* | t | c | 3",)))
def report_table(spark, sf):
    made = report.Report({}, {}, [report.TaskResult("t", {}, {"a": 0.5, "b": None, "c": 3})], modified=True)
    return rows(spark, [(x,) for x in made.table().split("\n")], "line string")


@query(values("task, setting, value", ("dist_approx", "feature", '"vector"'), ("dist_approx", "metric", '"cosine"'), ("dist_approx", "models", '["baseline", "rf"]'), ("dist_approx", "n_pairs", "300"), ("link_prediction", "max_pairs", "50"), ("link_prediction", "test_size", "0.5")))
def command_line(spark, sf):
    """Tasks and settings of a command line: options win over calls, calls over names."""
    args = cli.build_parser().parse_args(["g", "z", "-lp", "--task", "dist_approx(n_pairs=300, feature=distance)", "--da-feature", "vector", "--da-models", "baseline, rf", "--metric", "cosine", "--lp-max-pairs", "50", "--task", "link_prediction(test_size=0.5)"])
    return rows(spark, [(t, k, json.dumps(v)) for t, kw in cli.selected(args).items() for k, v in kw.items()], "task string, setting string, value string")


@query(values("text, outcome", ("dist_approx", "dist_approx []"), ("f(a=1, b=x)", 'f [["a", 1], ["b", "x"]]'), ("f(a)", "ValueError"), ("f(a=1", "ValueError"), ("f(a=true, b=0.5, c=none)", 'f [["a", true], ["b", 0.5], ["c", null]]'), ("1f", "ValueError")))
def parsed_calls(spark, sf):
    out = []
    for text in ("dist_approx", "f(a=1, b=x)", "f(a)", "f(a=1", "f(a=true, b=0.5, c=none)", "1f"):
        try:
            name, kw = report.parse_call(text)
            out.append((text, f"{name} {json.dumps(sorted(map(list, kw.items())))}"))
        except ValueError:
            out.append((text, "ValueError"))
    return rows(spark, out, "text string, outcome string")


@query(values("task, n", ("dist_approx", 13), ("dist_rank", 6), ("dist_stress", 4), ("link_prediction", 8), ("link_rank", 3), ("retrieval", 4), ("structure", 2)))
def task_settings(spark, sf):
    """Registered tasks and how many settings each takes."""
    return rows(spark, [(t, len(tasks.keywords(t))) for t in cli.ORDER if t in tasks.TASKS], "task string, n long")


@query(values("a, b, verdict", ("0.9", "0.9", "TIE"), ("0.9 0.5", "0.6 0.8", "TIE"), ("0.9 0.4", "0.3 0.8", "MEASUREMENT"), ("0.9 0.91", "0.5 0.52", "WIN"), ("0.1 0.11", "0.5 0.52", "LOSS")))
def compared(spark, sf):
    cases = (("0.9", "0.9"), ("0.9 0.5", "0.6 0.8"), ("0.9 0.4", "0.3 0.8"), ("0.9 0.91", "0.5 0.52"), ("0.1 0.11", "0.5 0.52"))
    of = lambda s: [float(x) for x in s.split()]
    return rows(spark, [(a, b, protocols.compare(of(a), of(b), 0.015)) for a, b in cases], "a string, b string, verdict string")


@query("SELECT '1.5000 ± 0.5000' AS cell, 'TBD' AS none, 'diverged' AS lost, 'm law rule' AS label, count(*) = 25 AS same FROM nation")
def store_cells(spark, sf):
    """Cells of result tables; settings give one key whatever their order."""
    n = T.table(spark, sf, "nation").count()
    same = baselines.fingerprint({"a": n, "b": 2}) == baselines.fingerprint({"b": 2, "a": 25}) != baselines.fingerprint({"a": n + 1, "b": 2})
    return rows(spark, [(store.cell([1.0, 2.0, None]), store.cell([None]), store.cell([1.0], True), store.label("rule", "law", "m"), same)], "cell string, none string, lost string, label string, same boolean")


@query("SELECT 'g' AS graph, 'm' AS method, 7::BIGINT AS seed, count(*)::BIGINT AS n, 0.5::DOUBLE AS rho FROM embeddings")
def stored_run(spark, sf):
    """Vectors and scores of a run saved and loaded."""
    at = place(spark, "store")
    store.save_run(T.vectors(spark, sf).select("id", "vec"), at, "g", "m", 7, {"rho": 0.5})
    n = spark.read.parquet(f"{at}/vectors").count()
    return store.load_runs(spark, at).select("graph", "method", F.col("seed").cast("long").alias("seed"), F.lit(n).cast("long").alias("n"), F.col("scores")["rho"].alias("rho"))


@query(values("name, value", ("loss", 0.5), ("epoch", 3.0), ("stage", 2.0)))
def log_lines(spark, sf):
    """Numbers and the last stage of a log, fields of RESULT lines."""
    path = written(spark, lines_of(spark, "walks begin", "epoch: 3", "embed begin", "RESULT\tloss=0.5\tx=y"), "log")
    got = S.parse_log(spark, path).where("name = 'epoch'").select("name", "value")
    loss = S.read_result_lines(spark, path).select(F.lit("loss").alias("name"), F.col("fields")["loss"].cast("double").alias("value"))
    last = ["walks", "embed", "score"].index(S.last_stage(spark, path, ["walks", "embed", "score"])) + 1.0
    return got.union(loss).union(rows(spark, [("stage", last)], "name string, value double"))
