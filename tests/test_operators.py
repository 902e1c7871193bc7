"""Properties of the graph operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import rng
from loomgraph.operators import augment as A
from loomgraph.operators import baselines as B
from loomgraph.operators import build as K
from loomgraph.operators import engine as E
from loomgraph.operators import graph as G
from loomgraph.operators import guards as C
from loomgraph.operators import laws as L
from loomgraph.operators import optim as O
from loomgraph.operators import pairs as P
from loomgraph.operators import paths as D
from loomgraph.operators import scores as M
from loomgraph.operators import walks as W
from loomgraph.plans import protocols as PR
from loomgraph.plans import report as R
from loomgraph.plans import tasks as T
from loomgraph.plans.cli import build_parser, selected
from loomgraph.sources import tables
from loomgraph.streaming import epochs as ST


@pytest.fixture(scope="module")
def tiny(spark):
    """A star of 20 nodes with chords."""
    rows = [(0, i) for i in range(1, 20)] + [(i, i % 19 + 1) for i in range(1, 20, 2)]
    return G.symmetric(spark.createDataFrame(rows, "src long, dst long")).cache()


@pytest.fixture(scope="module")
def grid(spark):
    n = 6
    rows = [(n * i + j, n * i + j + 1) for i in range(n) for j in range(n - 1)] + [(n * i + j, n * i + j + n) for i in range(n - 1) for j in range(n)]
    return G.symmetric(spark.createDataFrame(rows, "src long, dst long")).cache()


def test_draws_agree_between_spark_and_python(spark):
    got = [r.u for r in spark.range(20).select("id", rng.u01("walk", F.col("id"), 3).alias("u")).orderBy("id").collect()]
    assert got == [rng.u01_py("walk", i, 3) for i in range(20)]


def test_profiles(spark, grid):
    path = G.symmetric(spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long"))
    p = G.profile(path)
    assert p["is_tree"] and p["bipartite"] and p["diameter"] == 9 and p["components"] == 1 and p["m"] == 9
    p = G.profile(grid)
    assert not p["is_tree"] and p["bipartite"] and p["diameter"] == 10 and p["max_degree"] == 4


def test_walks(tiny):
    e = {(r.src, r.dst) for r in tiny.collect()}
    for walks in (W.graph_walk(tiny, 3, 6), W.graph_walk(tiny, 2, 5, 0.25, 4.0)):
        assert all((a, b) in e for r in walks.collect() for a, b in zip(r.path, r.path[1:]))
    back = lambda p, q: np.mean([a == c for r in W.graph_walk(tiny, 4, 8, p, q).collect() for a, c in zip(r.path, r.path[2:])])
    assert back(0.05, 1.0) > back(20.0, 1.0)


def test_gaps_bound_hops(tiny):
    rows = P.row_stats(W.graph_walk(tiny, 4, 8))
    true = D.all_pairs(tiny).select("u", "v", F.col("h").alias("hops"))
    r = D.hop_sample(true, rows.select("u", "v", F.col("mn").alias("h"))).first()
    assert r.under == 0 and r.n == rows.count()
    est = D.landmark_distance(D.landmark_table(tiny, D.pick_landmarks(tiny, 4)), true)
    assert est.where("est < hops").count() == 0


def test_neighbours_and_caps(tiny):
    rows = P.row_stats(W.graph_walk(tiny, 4, 8))
    assert P.with_all_neighbours(rows, tiny).where("mn = 1").count() == tiny.count()
    wide = {r.u: r.n for r in P.row_cap(rows, 3).groupBy("u").agg(F.count("*").alias("n")).collect()}
    full = {r.u: r.n for r in rows.groupBy("u").agg(F.count("*").alias("n")).collect()}
    assert wide == {u: min(3, n) for u, n in full.items()}
    P.assert_rows_unique(rows)
    with pytest.raises(ValueError):
        P.assert_rows_unique(rows.union(rows))


@pytest.mark.parametrize("weight", list(P.WEIGHTS))
def test_weights_are_whole_and_inside_the_window(tiny, weight):
    stats = P.pair_stats(W.graph_walk(tiny, 4, 8), 3)
    assert P.WEIGHTS[weight](stats, 3).where("h < 1 or h > 3 or h <> rint(h)").count() == 0


def test_every_policy_builds(tiny):
    for kw in ({"pairs": "walk"}, {"pairs": "walk_edges"}, {"pairs": "nbr_walk", "far": 5}, {"pairs": "walk", "policy": "buckets", "landmarks": 2, "far": 5}, {"pairs": "nbr_walk", "buckets": True, "neighbours": "low_deg", "freq_mode": "node"}):
        a = A.augment(tiny, walks=2, walk_len=5, **kw)
        assert a.info["nnz"] == a.table.count() > 0 and a.table.where("h < 1 or freq < 1 or u = v").count() == 0
    with pytest.raises(TypeError):
        A.AugmentSpec.of(unknown=1)


def test_far_pairs(tiny, spark):
    nodes = G.id_map(tiny).select(F.col("raw").alias("id"), F.col("id").alias("rank"))
    near = tiny.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    far = P.sample_far_pairs(nodes, 40, near).cache()
    assert far.count() == 40 == far.distinct().count() and far.where("u >= v").count() == 0 and far.join(near, ["u", "v"]).count() == 0
    most = 20 * 19 // 2 - near.count()
    assert P.sample_far_pairs(nodes, 10_000, near, max_tries=3).count() == most


def test_fused_law_is_the_same(tiny):
    t = A.augment(tiny, pairs="nbr_walk", walks=2, walk_len=5).table
    z, deg = E.initial(G.nodes_of(tiny), 3), L.near_degrees(t)
    a = E.pair_forces(t, z, deg, "linear").select("u", "v", "f")
    b = E.pair_forces(L.build_planes("linear_fused", t), z, deg, "linear_fused").select("u", "v", F.col("f").alias("g"))
    assert a.join(b, ["u", "v"]).where("abs(f - g) > 1e-9").count() == 0


def test_contract(tiny, spark):
    t = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 0.5, 1.0), (1, 0, 2.0, 0.0)], "u long, v long, h double, freq double")
    with pytest.raises(ValueError, match="bad_h 1, bad_freq 1, zero_degree 1"):
        L.check("linear", t, L.near_degrees(t))
    with pytest.raises(ValueError):
        L.build_planes("linear", t.drop("freq"))
    with pytest.raises(KeyError):
        L.law("none")


def vectors(z):
    return np.array([list(r.vec) for r in z.orderBy("id").collect()])


def test_batches_and_blocks_change_nothing(tiny):
    t = A.augment(tiny, pairs="nbr_walk", walks=2, walk_len=5).table.cache()
    runs = [vectors(E.Relaxation("hop", 3, lr=0.5).embed(t, 3, batches=b, block=k)) for b, k in ((1, True), (1, False), (3, False))]
    assert np.allclose(runs[0], runs[1]) and np.allclose(runs[0], runs[2])


@pytest.mark.parametrize("rule", [*O.RULES, "lbfgs"])
def test_rules_pull_neighbours_together(tiny, rule):
    t = A.augment(tiny, pairs="nbr_walk", walks=2, walk_len=5).table
    r = E.Relaxation("hop", 3, rule, lr=0.05 if rule in ("momentum", "nesterov") else 0.3, drop_rate=0.2)
    z = r.embed(t, 3)
    assert r.end_epoch == 3 and np.isfinite(vectors(z)).all() and O.state_arrays(rule) >= 0
    r.embed(t, 1)
    assert r.end_epoch == 4


def test_divergence_is_recorded_and_callbacks_are_told(tiny):
    seen = []

    class Watch(E.Callback):
        def epoch_end(self, **kw):
            seen.append(kw["epoch"])

    t = A.augment(tiny, pairs="nbr_walk", walks=2, walk_len=5).table
    r = E.Relaxation("hop", 2, lr=1e200)
    r.attach(Watch())
    r.embed(t, 5)
    assert r.diverged and len(seen) < 5
    with pytest.raises(TypeError):
        r.attach(object())
    with pytest.raises(KeyError):
        r.notify("never")


def test_schedules():
    for name, f in E.DECAYS.items():
        assert f(0, 10) == pytest.approx({"linear_sine": 0.0, "sigmoid": 1 / (1 + math.exp(-5))}.get(name, 1.0)) and E.linear_decay(12, 10) == 0


def test_streaming_batches(spark, tiny, tmp_path):
    z, facts = ST.run(tiny, 2, 2, d=3, n_walks=2, length=5)
    assert not facts["diverged"] and z.count() == 20
    ids = tmp_path / "ids"
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(ids))
    src = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(ids))
    done = []
    q = ST.stream(spark, src, tiny, E.initial(G.nodes_of(tiny), 3), str(tmp_path / "state"), d=3, n_walks=2, length=5, on_batch=lambda z, n: done.append(z.count()))
    assert q.awaitTermination(180) and done == [20, 20] and ST.state(spark, str(tmp_path / "state"), 2).count() == 20


def test_spanning_trees_and_neighbours(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(40, 3))
    z = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<double>").cache()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = {r.id: [] for r in z.collect()}
    for row in K.knn_exact(z, 4).orderBy("id", "rank").collect():
        near[row.id].append(row.neighbour)
    assert all(near[i] == [j for j in np.argsort(d[i], kind="stable") if j != i][:4] for i in range(40))
    inside, total = {0}, 0.0
    while len(inside) < 40:
        w, j = min((d[i, j], j) for i in inside for j in range(40) if j not in inside)
        inside.add(j)
        total += w
    for f in (K.mst_exact, lambda z: K.mst_on_knn(z, 8)):
        tree = f(z).collect()
        assert len(tree) == 39 and sum(t.w for t in tree) == pytest.approx(total)
    raised = G.symmetric(K.mst_k_minimum(z, 3))
    assert G.degrees(raised).where("deg < 3").count() == 0
    assert K.union_mst_knn(z, 3).where("tag = 'mst'").count() == 39 and "mst" in K.strategies()
    with pytest.raises(KeyError):
        K.make_graph(z, "none")


def test_scores(spark):
    r = np.random.default_rng(1)
    y = r.integers(1, 6, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y + r.normal(0, 1, 300), y)], "x double, y double").cache()
    s = M.stress1(df).first()
    assert M.stress1(df.withColumn("x", F.col("x") * 3)).first().stress1 == pytest.approx(s.stress1)
    assert M.tau_b_max(df).first()[0] ** 2 == pytest.approx(1 - M.tie_frac(df).first()[0])
    a, b = M.isotonic_fit(df), M.isotonic_fit(df.withColumn("x", F.col("x") * 7))
    assert a["isotonic_r2"] == pytest.approx(b["isotonic_r2"]) and 0 < a["isotonic_r2"] < 1
    with pytest.raises(ValueError):
        M._ranked(df.withColumn("x", F.lit(1.0)), "x")


def test_guards(spark):
    z = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0])], "id long, vec array<double>")
    with pytest.raises(ValueError, match="C1"):
        C.check_shape(z, 4)
    assert "C2" in C.check_finite(z, False) and "C3" in C.check_zero_rows(z, False)
    assert C.check_sample_shortfall(5, 10) is None and "C8" in C.check_sample_shortfall(4, 10, False)


def test_evaluate(spark, grid, tmp_path):
    z = B.spectral(grid, 2, 15)
    rep = T.evaluate(spark, grid, z, tasks=("retrieval", "link_rank", "dist_stress", "dist_rank"), protocol="measure_quick", n_pairs=200, n_sources=20, n_boot=50, strict=False)
    assert rep.modified and rep.results[1].scores["auc"] > 0.7 and "measure_quick*" in rep.table()
    rep.write(str(tmp_path / "r.json"))
    rep.write(str(tmp_path / "r.jsonl"))
    with pytest.raises(ValueError):
        rep.write(str(tmp_path / "r.txt"))
    with pytest.raises(TypeError):
        T.evaluate(spark, grid, z, nothing=1)


def test_records_and_calls():
    assert R.parse_call("a(b=1, c=x, d=2.5, e=true)") == ("a", {"b": 1, "c": "x", "d": 2.5, "e": True})
    for bad in ("a(", "1a", "a(b)"):
        with pytest.raises(ValueError):
            R.parse_call(bad)
    assert R.validate(R.Context(rule="momentum", lr=0.2), 8)["warnings"] and R.regime(8, "H") == "low"
    assert PR.compare([1.0, 1.0], [0.5, 0.5], 0.01) == "WIN" and PR.compare([1.0], [1.005], 0.01) == "TIE"
    assert PR.override(PR.LinkPrediction(), max_pairs=None) == (PR.LinkPrediction(), False)
    with pytest.raises(KeyError):
        PR.protocol("none")
    args = build_parser().parse_args(["g", "z", "--task", "retrieval(k=3)", "--tasks", "link_prediction"])
    assert selected(args) == {"link_prediction": {}, "retrieval": {"k": 3}}


@pytest.mark.parametrize("method", ["landmark_mds", "random_projection", "spectral", "line", "poincare", "netmf", "grarep", "hope", "prone"])
def test_other_embeddings(grid, method):
    z = B.embed(method, grid, 4)
    assert z.count() == 36 and np.isfinite(vectors(z)).all() and vectors(z).shape == (36, 4)


def test_seven_columns_are_cached(spark, grid):
    from loomgraph.plans import seven

    z, cache = B.spectral(grid, 2, 15).cache(), {}
    entries = [{"graph": "grid", "method": "spectral", "seed": 1, "z": z}, {"graph": "grid", "method": "again", "seed": 2, "z": z}]
    rows = seven.sequence(entries, lambda name: grid, cache, max_pairs=60, n_pairs=200, trees=5)
    assert len(cache) == 1 and set(seven.COLUMNS) <= set(rows[0]) and rows[1]["rho"] == rows[0]["rho"] > 0.5


def test_approximate_neighbours_have_recall(spark, sf_dir):
    z = tables.vectors(spark, sf_dir)
    exact, near = K.knn(z, 10).select("id", "neighbour"), K.knn(z, 10, exact=False).select("id", "neighbour")
    assert near.join(exact, ["id", "neighbour"]).count() >= 0.9 * exact.count()
    with pytest.raises(ValueError):
        K.knn(z, 10, "cosine", exact=False)


def test_neighbours_with_ties_and_few_points(spark):
    z = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(7)], "id long, vec array<double>")
    got = {(r.id, r.rank): r.neighbour for r in K.knn_exact(z, 3).collect()}
    assert got[0, 1] == 3 and got[0, 2] == 6 and got[0, 3] == 1 and got[1, 1] == 4
    one = spark.createDataFrame([(5, [1.0])], "id long, vec array<double>")
    assert K.knn_exact(one, 3).count() == 0


def test_exact_counts_of_dropped_batches_and_rows(spark):
    for epoch in range(5):
        kept = E.batch_subset(10, 0.3, epoch)
        assert len(kept) == 7 and kept == sorted(set(kept)) and kept == E.batch_subset(10, 0.3, epoch)
    assert E.batch_subset(3, 0.99, 0) and len({tuple(E.batch_subset(10, 0.3, k)) for k in range(8)}) > 1
    assert E.row_subset_count(spark.range(50), 0.3, 1).count() == 35
    pairs = spark.createDataFrame([(u, v, 1.0, 1.0) for u in range(6) for v in range(6) if u != v], "u long, v long, h double, freq double")
    for strategy in ("row_subset_count", "batch_subset"):
        z = E.Relaxation("hop", 2, drop_rate=0.5, drop_strategy=strategy).embed(pairs, 1, batches=4)
        first = {r.id: r.vec for r in E.initial(spark.range(6), 2).collect()}
        assert 0 < sum(first[r.id] != r.vec for r in z.collect()) < 6


def test_command_line_options():
    parse = lambda *a: selected(build_parser().parse_args(["g", "z", *a]))
    assert parse() == {"link_prediction": {}} and len(parse("--all")) == 7
    assert parse("--da-pairs", "5") == {"dist_approx": {"n_pairs": 5}}
    assert parse("-lp", "--metric", "cosine", "--tasks", "retrieval") == {"link_prediction": {}, "retrieval": {"metric": "cosine"}}
    with pytest.raises(TypeError):
        parse("--task", "retrieval(n_pairs=3)")
    with pytest.raises(KeyError):
        parse("--tasks", "nothing")


def test_searches_by_bits_are_those_by_joins(spark, monkeypatch):
    """More sources than a word has bits, two components, a lone source, a null; the small graph is searched without joins."""
    from loomgraph.operators import paths

    links = [(i, i + 1) for i in range(0, 140)] + [(i, (i * 7) % 60) for i in range(60)] + [(500, 501), (501, 502)]
    e = G.symmetric(spark.createDataFrame(links, "src long, dst long")).cache()
    sources = G.nodes_of(e).union(spark.createDataFrame([(900,), (None,)], "id long"))
    told = lambda df: sorted(df.collect(), key=str)
    joins = []
    cut = paths.cut
    monkeypatch.setattr(paths, "cut", lambda df, name="step": joins.append(name) or cut(df, name))
    by_bits = [told(paths.bfs(e, sources)), told(paths.bfs(e, sources, 3)), told(paths.hop_fill(e))]
    assert len(joins) <= 5
    monkeypatch.setattr(paths, "fits", lambda *_: False)
    by_joins = [told(paths.bfs(e, sources.where("id < 8 or id > 130 or id is null"))), told(paths.bfs(e, sources, 3))]
    assert [r for r in by_bits[0] if r.source is None or r.source < 8 or r.source > 130] == by_joins[0]
    assert by_bits[1] == by_joins[1]
    n = G.nodes_of(e).count()
    near = {(r.source, r.node): r.dist for r in by_bits[0]}
    assert {(r.u, r.v): r.h for r in by_bits[2]} == {(a, b): near.get((a, b), n) for a in {*near_ids(e)} for b in {*near_ids(e)}}
    assert len(by_bits[2]) == n * n


def near_ids(e):
    return [r.id for r in G.nodes_of(e).collect()]


def test_tree_by_blocks_is_the_tree_of_all_pairs(spark, monkeypatch):
    """Grid points (many ties), copies of points, one point; pairs are not stored."""
    rows = [(i * 3, [float(i % 7), float(i // 7)]) for i in range(60)] + [(1000 + i, [2.0, 3.0]) for i in range(3)]
    z = spark.createDataFrame(rows, "id long, vec array<double>").cache()
    of, want = {i: i for i, _ in rows}, []
    for w, a, b in sorted((sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5, a, b) for a, x in rows for b, y in rows if a < b):
        if of[a] != of[b]:
            of = {i: of[a] if c == of[b] else c for i, c in of.items()}
            want.append((a, b, w))
    monkeypatch.setattr(K, "complete_edges", lambda z: pytest.fail("all pairs"))
    assert sorted(map(tuple, K.mst_exact(z).collect())) == sorted(want) and len(want) == 62
    assert K.mst_exact(z.limit(1)).count() == 0


def test_hops_of_pairs_store_no_other_distances(spark, monkeypatch):
    """Rows written grow with the pairs, not with sources times nodes; ends out of reach, unknown and null."""
    ring = [(i, (i + 1) % 300) for i in range(300)] + [(1000, 1001)]
    e = spark.createDataFrame(ring + [(b, a) for a, b in ring], "src long, dst long")
    asked = [(i, (i * 7 + 3) % 300) for i in range(300)] + [(1000, 1001), (1000, 5), (5, 77777), (8888, 8888), (8888, 5), (None, 5), (5, None), (4, 4)]
    pairs, made, write = spark.createDataFrame(asked, "u long, v long"), [], D.cut

    def counted(df, name="step"):
        out = write(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(D, "cut", counted)
    got = {(r.u, r.v): r.hops for r in D.hop_distance(e, pairs).collect()}
    around = lambda a, b: float(min((a - b) % 300, (b - a) % 300))
    want = {(a, b): around(a, b) for a, b in asked[:300]} | {(1000, 1001): 1.0, (1000, 5): None, (5, 77777): None, (8888, 8888): 0.0, (8888, 5): None, (None, 5): None, (5, None): None, (4, 4): 0.0}
    assert got == want and max(made) <= len(asked)
    monkeypatch.setattr(D, "_pair_hops", lambda *_: None)
    made.clear()
    assert {(r.u, r.v): r.hops for r in D.hop_distance(e, pairs).collect()} == want
    assert max(made) > len(asked)


def test_approximate_search_of_queries_splits_a_full_bucket(spark, sf_dir, monkeypatch):
    """Buckets of half of all points, in many blocks, give the exact neighbours of the queries; the usual ones have recall."""
    z = tables.vectors(spark, sf_dir)
    asked = z.where("id % 50 = 0")
    told = lambda df: {(r.id, r.rank): r.neighbour for r in df.collect()}
    exact = told(K.knn_exact(z, 10, queries=asked))
    monkeypatch.setattr(K, "BUCKET_ROWS", 37)
    assert told(K.knn_approx(z, 10, 1e9, 24, queries=asked)) == exact  # two buckets a table, by sign
    near = told(K.knn_approx(z, 10, queries=asked))
    pairs = lambda x: {(i, n) for (i, _), n in x.items()}
    assert len(pairs(near) & pairs(exact)) >= 0.9 * len(exact)


def test_bits_take_four_bytes_an_edge(spark, monkeypatch):
    """Edges that fit the bound in four bytes are searched by bits, step by step; one byte less and they aren't."""
    from loomgraph.plans import state

    e = G.symmetric(spark.createDataFrame([(i, (i * i + 7) % 97) for i in range(97)] + [(200, 201)], "src long, dst long")).cache()
    sources, least = G.nodes_of(e), 4 * e.count() + 8 * G.nodes_of(e).count()
    told = lambda df: sorted(map(tuple, df.select("source", "node", "dist").collect()))
    monkeypatch.setattr(state, "BROADCAST_BYTES", least - 1)
    assert D._searched(e, sources) is None
    by_joins = told(D.bfs(e, sources))
    monkeypatch.setattr(state, "BROADCAST_BYTES", least)
    monkeypatch.setattr(D, "_STEP", 10)
    found = D._searched(e, sources)
    assert found is not None and told(found) == by_joins
    assert D._pair_hops(e, sources.selectExpr("id as u", "(id + 5) % 97 as v")) is not None


def test_shells_are_counted_in_the_tasks(spark, monkeypatch):
    e = G.symmetric(spark.createDataFrame([(i, (i * 31 + 11) % 400) for i in range(400)], "src long, dst long")).cache()
    want = sorted(map(tuple, D.shell_counts(D.all_pairs(e)).collect()))
    monkeypatch.setattr(D, "all_pairs", lambda *_: pytest.fail("a row for a pair"))
    assert sorted(map(tuple, D.all_shells(e).collect())) == want


def test_counts_and_draws_of_all_pairs_store_no_pairs(spark, monkeypatch):
    """Shells, the least keys of each source and of each hop: few rows are written, also where a bound lets through too few."""
    from loomgraph.operators import sampling as S

    e = G.symmetric(spark.createDataFrame([(i, (i * 31 + 11) % 400) for i in range(400)] + [(i, (i + 1) % 400) for i in range(400)], "src long, dst long")).cache()
    nodes, made, write = G.nodes_of(e), [], D.cut
    told = lambda df: sorted(map(tuple, df.collect()))

    def counted(df, name="step"):
        out = write(df, name)
        made.append(out.count())
        return out

    pairs = D.all_pairs(e).cache()
    want = [told(D.shell_counts(pairs)), told(S.stratified(pairs.withColumnRenamed("h", "hops"), 40))]
    with monkeypatch.context() as m:
        m.setattr(D, "_least_keys", lambda *_: None)
        want.append(told(D.bfs_rows(e, nodes, 2)))

    def got():
        near, totals = D.pairs_and_totals(e)
        return [told(D.all_shells(e)), told(S.stratified(near.withColumnRenamed("h", "hops"), 40, totals=totals)), told(D.bfs_rows(e, nodes, 2))]

    monkeypatch.setattr(D, "cut", counted)
    monkeypatch.setattr(S, "cut", counted)
    assert got() == want and max(made) < pairs.count() / 4
    for module in (D, S):
        monkeypatch.setattr(module, "key_bound", lambda *_: F.lit("02"))
    assert got() == want


def test_stored_gaps_are_held_against_their_own_hops_alone(spark, sf_dir, monkeypatch):
    from loomgraph.plans.q_pairs import hop_sample

    monkeypatch.setattr(D, "all_pairs", lambda *_: pytest.fail("all pairs"))
    assert hop_sample(spark, sf_dir).first().n > 0


def test_joins_from_both_ends_give_the_hops_of_pairs(spark, monkeypatch):
    """Without bits, connected pairs meet half way; pairs of two components are left out before any level is made."""
    e = G.symmetric(spark.createDataFrame([(i + c, (i * 7 + 3) % 80 + c) for c in (0, 1000) for i in range(80)] + [(i + c, i + 1 + c) for c in (0, 1000) for i in range(79)], "src long, dst long")).cache()
    pairs = spark.createDataFrame([(i, (i * 13 + 5) % 80 + 1000 * (i % 2)) for i in range(80)] + [(5, 5), (7, 5000), (None, 3)], "u long, v long")
    want, levels, write = sorted(map(tuple, D._pair_hops(e, pairs).collect())), [], D.cut

    def counted(df, name="step"):
        out = write(df, name)
        if name == "level":
            levels.append(out.count())
        return out

    monkeypatch.setattr(D, "cut", counted)
    monkeypatch.setattr(D, "_pair_hops", lambda *_: None)
    monkeypatch.setattr(D, "bfs", lambda *_, **__: pytest.fail("search of all nodes"))
    D.hop_distance(e, pairs)
    assert sorted(map(tuple, D._met_hops(e, pairs).collect())) == want and max(levels[:2]) <= 41
    monkeypatch.setattr(D, "fits", lambda *_: False)
    assert sorted(map(tuple, D._met_hops(e, pairs).collect())) == want
