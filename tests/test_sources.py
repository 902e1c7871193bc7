"""Readers and writers, the store, the generators."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import walks as W
from loomgraph.sources import files as S
from loomgraph.sources import store


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def pairs(df):
    return sorted(tuple(r) for r in df.select("src", "dst").collect())


def test_edge_formats(spark, tmp_path):
    assert pairs(S.read_edges(spark, "citation", put(tmp_path, "a", "1\t2\n3 4\n"))) == [(1, 2), (3, 4)]
    assert pairs(S.read_edges(spark, "named", put(tmp_path, "b", "x1 y\ny z\n"))) == [("x1", "y"), ("y", "z")]
    assert pairs(S.read_edges(spark, "papers", put(tmp_path, "c", "HEAD\nNO\n0\tpaper:5\t|\tpaper:7\n"))) == [(5, 7)]
    assert pairs(S.read_edges(spark, "tabbed", put(tmp_path, "d", "# c\n1\t2\n"))) == [(1, 2)]
    noun = "  1 licence\n00001740 03 n 02 entity 0 thing 0 003 @ 00001930 n 0000 ~ 00002137 n 0000 @i 04424418 n 0000 | text\n"
    assert pairs(S.read_edges(spark, "nouns", put(tmp_path, "e", noun))) == [(1740, 1930), (1740, 4424418)]
    assert pairs(S.read_edges(spark, "taxonomy", put(tmp_path, "f", "1\t|\t1\t|\tx\n2\t|\t1\t|\ty\n"))) == [(2, 1)]
    with pytest.raises(KeyError):
        S.read_edges(spark, "other", "x")


def test_matrix_market_in_several_files(spark, tmp_path):
    """The size line lies in the file with the banner, which need not be the largest; an entry may look like it."""
    folder = tmp_path / "parts.mtx"
    folder.mkdir()
    put(folder, "part-0.txt", "%%MatrixMarket matrix coordinate pattern symmetric\n40 40 32\n2 1\n")
    put(folder, "part-1.txt", "".join(f"{i + 1} {i}\n" for i in range(2, 33)))
    assert pairs(S.matrix_market(spark, str(folder))) == [(i, i - 1) for i in range(1, 33)]
    one = put(tmp_path, "same.mtx", "%%MatrixMarket matrix coordinate integer general\n2 2 2\n1 2 5\n2 2 2\n")
    assert pairs(S.matrix_market(spark, one)) == [(0, 1), (1, 1)]


def test_load_graph_by_ending(spark, tmp_path):
    want = [(0, 1), (1, 0), (1, 2), (2, 1)]
    np.savez(tmp_path / "g.npz", edges=np.array([[0, 1], [1, 2], [2, 2]]))
    for src in (put(tmp_path, "g.csv", "# c\n0,1\n1,2\n"), put(tmp_path, "g.txt", "0 1\n1 2\n"), put(tmp_path, "g.mtx", "%%MatrixMarket\n3 3 2\n1 2\n2 3\n"), str(tmp_path / "g.npz")):
        e, facts = S.load_graph(spark, src)
        assert pairs(e) == want and facts["n"] == 3 and facts["n_edges"] == 2
    e, _ = S.load_graph(spark, spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    S.write_matrix_market(e, 3, str(tmp_path / "out.mtx"))
    assert pairs(G.symmetric(S.matrix_market(spark, str(tmp_path / "out.mtx")))) == want


def test_embedding_formats(spark, tmp_path):
    nodes = spark.range(3)
    read = lambda df: {r.id: [float(x) for x in r.vec] for r in df.collect()}
    assert read(S.load_embedding(spark, put(tmp_path, "z.txt", "2 2\n0 1 2\n2 3 4\n"), nodes)[0]) == {0: [1, 2], 1: [0, 0], 2: [3, 4]}
    z, facts = S.load_embedding(spark, put(tmp_path, "z.csv", "0,1.5,2\n2,3,4\n"), nodes)
    assert read(z) == {0: [1.5, 2], 1: [0, 0], 2: [3, 4]} and facts["zero_rows"] == 1
    assert read(S.embedding_embd(spark, put(tmp_path, "z.embd", "2 2\n1 1 2\n3 3 4\n"), 3, 2)) == {0: [1, 2], 1: [0, 0], 2: [3, 4]}
    with pytest.raises(ValueError):
        S.embedding_embd(spark, str(tmp_path / "z.embd"), 3, 5)
    np.savez(tmp_path / "z.npz", Z=np.eye(2))
    assert read(S.load_embedding(spark, str(tmp_path / "z.npz"))[0]) == {0: [1, 0], 1: [0, 1]}


def test_profiles_and_records(spark, tmp_path):
    e = G.symmetric(spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long"))
    assert S.read_profile(e, str(tmp_path)) is None
    S.write_profile(e, {"n": 7}, str(tmp_path))
    assert S.read_profile(e.repartition(3), str(tmp_path)) == {"n": 7}
    assert S.read_context(put(tmp_path, "c.json", json.dumps({"a": 1}))) == {"a": 1}
    got = S.read_result_lines(spark, put(tmp_path, "r.tsv", "noise\nRESULT\ta=1\tb=x\n")).first().fields
    assert got == {"a": "1", "b": "x"}
    log = put(tmp_path, "log", "load ok\nauc: 0.5\nwalk done\nhops=2.5e1\n")
    assert {r.name: r.value for r in S.parse_log(spark, log).collect()} == {"auc": 0.5, "hops": 25.0}
    assert S.last_stage(spark, log, ["load", "walk", "embed"]) == "walk"


def test_walks_are_written(spark, tmp_path):
    e = G.symmetric(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    S.write_walks(W.uniform_walks(e, W.starts_of(G.nodes_of(e), 2), 4), str(tmp_path / "w"))
    rows = [r.value.split() for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert len(rows) == 6 and all(len(r) == 4 and abs(int(a) - int(b)) == 1 for r in rows for a, b in zip(r, r[1:]))


def test_generators(spark):
    for f in (S.swiss_roll, S.s_curve, S.clusters, S.closed_curve):
        assert f(spark, 50).where(F.size("vec") == 3).count() == 50
    e = G.symmetric(S.preferential(spark, 100, 3))
    assert G.nodes_of(e).count() == 100 and G.components(e).select("component").distinct().count() == 1


def test_store(spark, tmp_path):
    z = spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<double>")
    for seed in (1, 2, 2):
        store.save_run(z, str(tmp_path), "g", "m", seed, {"rho": 0.5})
    runs = store.load_runs(spark, str(tmp_path))
    assert store.latest(runs).count() == 2 and store.census(runs).first().n_seeds == 2
    assert store.missing(store.latest(runs), spark.createDataFrame([("g", "m", 1)], "graph string, method string, seed long")).count() == 1
    assert store.cell([1.0, 3.0]) == "2.0000 ± 1.0000" and store.cell([None]) == "TBD" and store.cell([], True) == "diverged"
    with pytest.raises(ValueError):
        store.save_run(spark.createDataFrame([(0, [float("nan")])], "id long, vec array<double>"), str(tmp_path), "g", "m", 3)
