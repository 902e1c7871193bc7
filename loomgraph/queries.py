"""The query catalogue of the graph operators, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import augment, engine
from .plans import q_files, q_forces, q_graph, q_pairs, q_scores
from .plans.state import cut

_PARTS = (q_graph, q_pairs, q_forces, q_scores, q_files)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From purchases to a graph, its pair table and a relaxed embedding: id, z0 .. z3."""
    edges = cut(q_graph.edges(spark, sf_dir, "basket"), "edges")
    table = augment.augment(edges, pairs="walk_edges", walks=2, walk_len=6, window=3, cap=8).table
    z = engine.Relaxation("hop", 4, "plain", 0.9, "linear").embed(table, 3)
    return z.select("id", *[F.round(F.col("vec")[i], 5).alias(f"z{i}") for i in range(4)])


QUERIES = {"flagship": flagship} | {name: f for part in _PARTS for name, f in part.Q.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
ORACLES["flagship"] = q_graph.with_edges("basket", q_pairs.walk_edges_sql(8) + q_forces.START + q_forces.epochs_sql(3, 0.9) + " SELECT id, " + ", ".join(f"round(vec[{i + 1}], 5) AS z{i}" for i in range(4)) + " FROM z3")
