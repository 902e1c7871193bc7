"""Queries on pair tables, with DuckDB's forms."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.rng import below_sql, key_sql
from ..operators import augment as A
from ..operators import graph as G
from ..operators import pairs as P
from ..operators import paths as D
from .q_graph import LENGTH, WALKS, _bfs_sql, edges, longs, walk_sql, walks, with_edges
from .state import cut

Q: dict = {}
SQL: dict[str, str] = {}
WINDOW, CAP = 3, 4


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BASE = walk_sql(WALKS, LENGTH)
# undirected statistics and directed rows of the walks
UND = BASE + f""", pos AS (SELECT path[i + 1] AS a, path[i + g + 1] AS b, g FROM walks, (SELECT unnest(range({LENGTH})) AS i), (SELECT unnest(range(1, {WINDOW + 1})) AS g) WHERE i + g < {LENGTH}),
st0 AS MATERIALIZED (SELECT least(a, b) AS u, greatest(a, b) AS v, min(g)::BIGINT AS mn, sum(g)::BIGINT AS sm, count(*)::BIGINT AS cnt FROM pos WHERE a <> b GROUP BY 1, 2)"""
ROWS = BASE + f", rw AS MATERIALIZED (SELECT start AS u, path[i + 1] AS v, min(i)::BIGINT AS mn, count(*)::BIGINT AS cnt FROM walks, (SELECT unnest(range(1, {LENGTH})) AS i) WHERE path[i + 1] <> start GROUP BY 1, 2)"
NBR = ROWS + ", nb AS MATERIALIZED (SELECT u, v, min(mn) AS mn, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM rw UNION ALL SELECT src, dst, 1, 1 FROM e) GROUP BY 1, 2)"


def capped_sql(cap: int) -> str:
    return UND + f""", ends AS (SELECT u AS node, 0 AS side, u, v, cnt FROM st0 UNION ALL SELECT v, 1, u, v, cnt FROM st0),
kept AS (SELECT DISTINCT u, v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cnt DESC, side, u, v) AS r FROM ends) WHERE r <= {cap}),
cp AS MATERIALIZED (SELECT st0.* FROM st0 JOIN kept USING (u, v))"""


CAPPED = capped_sql(CAP)


def und(spark, sf):
    return cut(P.pair_stats(walks(spark, sf), WINDOW), "und")


def rows(spark, sf):
    return cut(P.row_stats(walks(spark, sf)), "rows")


def both(spark, sf):
    return cut(edges(spark, sf, "basket"), "edges")


@query(with_edges("basket", UND + " SELECT u, v, mn, sm, cnt FROM st0"))
def walk_pair_stats(spark, sf):
    return longs(P.pair_stats(walks(spark, sf), WINDOW), "u", "v", "mn", "sm", "cnt")


@query(with_edges("basket", ROWS + " SELECT u, v, mn, cnt FROM rw"))
def walk_rows(spark, sf):
    return longs(P.row_stats(walks(spark, sf)), "u", "v", "mn", "cnt")


@query(with_edges("users", _bfs_sql("deg", 2) + f" SELECT source AS u, node AS v, dist AS mn, dist AS sm, greatest({WINDOW + 1} - dist, 1)::BIGINT AS cnt FROM bfs WHERE source < node"))
def ball_stats(spark, sf):
    return P.ball_stats(D.all_pairs(cut(edges(spark, sf, "users"), "edges"), 2), WINDOW)


@query(with_edges("basket", CAPPED + " SELECT u, v, mn, sm, cnt FROM cp"))
def cap_per_node(spark, sf):
    return longs(P.cap_per_node(und(spark, sf), CAP), "u", "v", "mn", "sm", "cnt")


@query(with_edges("basket", ROWS + f" SELECT u, v, mn, cnt FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY cnt DESC, v) AS r FROM rw) WHERE r <= {CAP}"))
def row_cap(spark, sf):
    return longs(P.row_cap(rows(spark, sf), CAP), "u", "v", "mn", "cnt")


@query(with_edges("basket", NBR + " SELECT u, v, mn, cnt FROM nb"))
def with_all_neighbours(spark, sf):
    return longs(P.with_all_neighbours(rows(spark, sf), both(spark, sf)), "u", "v", "mn", "cnt")


@query(with_edges("supply", walk_sql(WALKS, LENGTH) + f""", rw AS (SELECT start AS u, path[i + 1] AS v, min(i)::BIGINT AS mn, count(*)::BIGINT AS cnt FROM walks, (SELECT unnest(range(1, {LENGTH})) AS i) WHERE path[i + 1] <> start GROUP BY 1, 2),
lo AS (SELECT e.src, e.dst FROM e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst WHERE b.deg >= a.deg) SELECT u, v, min(mn) AS mn, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM rw UNION ALL SELECT src, dst, 1, 1 FROM lo) GROUP BY 1, 2"""))
def with_low_degree_neighbours(spark, sf):
    e = cut(edges(spark, sf, "supply"), "edges")
    return longs(P.with_low_degree_neighbours(P.row_stats(walks(spark, sf, "supply")), e), "u", "v", "mn", "cnt")


@query(with_edges("basket", UND + " SELECT u, v, mn, sm, cnt FROM st0 UNION ALL SELECT src, dst, 1, 1, 1 FROM e WHERE src < dst AND NOT EXISTS (SELECT 1 FROM st0 WHERE u = src AND v = dst)"))
def add_missing_edges(spark, sf):
    return longs(P.add_missing_edges(und(spark, sf), both(spark, sf)), "u", "v", "mn", "sm", "cnt")


# weights
_W = {
    "flat": "1.0::DOUBLE",
    "min_gap": "mn::DOUBLE",
    "mean_gap": f"least(greatest(round_even(sm::DOUBLE / cnt, 0), 1.0), {WINDOW}.0)",
}


def _weight(name: str):
    def f(spark, sf):
        return P.WEIGHTS[name](und(spark, sf), WINDOW).select("u", "v", "h")

    f.__name__ = f"weight_{name}"
    return f


for _n, _x in _W.items():
    query(with_edges("basket", UND + f" SELECT u, v, {_x} AS h FROM st0"))(_weight(_n))
query(
    with_edges(
        "basket",
        UND
        + f""", ce AS (SELECT id, sum(cnt) AS c FROM (SELECT u AS id, cnt FROM st0 UNION ALL SELECT v, cnt FROM st0) GROUP BY 1), tt AS (SELECT sum(cnt) AS t FROM st0),
pm AS MATERIALIZED (SELECT st0.u, st0.v, ln((cnt * t)::DOUBLE / (a.c * b.c)::DOUBLE) AS pmi FROM st0 JOIN ce a ON a.id = u JOIN ce b ON b.id = v, tt),
lim AS (SELECT quantile_cont(pmi, 0.01) AS lo, quantile_cont(pmi, 0.99) AS hi FROM pm)
SELECT u, v, CASE WHEN hi > lo THEN least(greatest(round_even({WINDOW} - (least(greatest(pmi, lo), hi) - lo) / (hi - lo) * {WINDOW - 1}, 0), 1.0), {WINDOW}.0) ELSE 1.0 END AS h FROM pm, lim""",
    )
)(_weight("pmi"))


# strata
def _bucket_sql(table: str, h: str, total: str) -> str:
    # quotas: half of the budget at 2, a quarter each at 3 and beyond; Python rounds halves to even
    k = key_sql("bucket", "u", "v")
    quota = f"round_even({total} * CASE s WHEN 2 THEN 0.5 ELSE 0.25 END, 0)"
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {k}, u, v) AS r FROM (SELECT *, CASE WHEN {h} <= 2 THEN 2 WHEN {h} = 3 THEN 3 ELSE 4 END AS s FROM {table})) WHERE r <= {quota})"


@query(with_edges("basket", UND + f", far AS (SELECT * FROM st0 WHERE mn >= 2) SELECT u, v, mn, sm, cnt FROM {_bucket_sql('far', 'mn', '1000.0')}"))
def bucket_sample(spark, sf):
    return longs(P.bucket_sample(und(spark, sf).where("mn >= 2"), 1000, h="mn"), "u", "v", "mn", "sm", "cnt")


_BUDGET = "floor((SELECT count(*) FROM deg) * log10((SELECT count(*) FROM deg)))"


@query(with_edges("basket", NBR + f", far AS (SELECT * FROM nb WHERE mn > 1) SELECT u, v, mn, cnt FROM nb WHERE mn <= 1 UNION ALL SELECT u, v, mn, cnt FROM {_bucket_sql('far', 'mn', _BUDGET)}"))
def row_buckets(spark, sf):
    e = both(spark, sf)
    return longs(P.row_buckets(cut(P.with_all_neighbours(rows(spark, sf), e), "nb"), G.nodes_of(e).count()), "u", "v", "mn", "cnt")


# far pairs
def _far_sql(count: str, near: str, name: str = "far", seed: int = 42) -> str:
    """Candidates of the first round, by number; enough unless most of them are stored pairs."""
    n = "(SELECT count(*) FROM deg)"
    end = lambda x: below_sql(n, "far", "i", f"'{x}'", seed=seed)
    return f""", rk AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM deg), cd AS MATERIALIZED (SELECT i, {end('a')} AS ka, {end('b')} AS kb FROM (SELECT unnest(range((2 * {count} + 1024)::BIGINT)) AS i)),
cn AS (SELECT i, least(a.id, b.id) AS u, greatest(a.id, b.id) AS v FROM cd JOIN rk a ON a.k = ka JOIN rk b ON b.k = kb WHERE a.id <> b.id),
ca AS (SELECT u, v, min(i) AS i FROM cn GROUP BY 1, 2), {name} AS MATERIALIZED (SELECT u, v FROM (SELECT *, row_number() OVER (ORDER BY i) AS r FROM ca WHERE NOT EXISTS (SELECT 1 FROM {near} s WHERE s.u = ca.u AND s.v = ca.v)) WHERE r <= {count})"""


def ranked(e):
    return cut(G.id_map(e).select(F.col("raw").alias("id"), F.col("id").alias("rank")), "nodes")


@query(with_edges("basket", UND + _far_sql("5000", "st0") + " SELECT u, v FROM far"))
def far_pairs_uniform(spark, sf):
    return P.sample_far_pairs(ranked(both(spark, sf)), 5000, und(spark, sf))


@query(with_edges("supply", " SELECT id, round(coalesce(lag(hi) OVER (ORDER BY id), 0), 9) AS low, round(hi, 9) AS high FROM (SELECT id, sum(deg ** 0.75) OVER (ORDER BY id) / sum(deg ** 0.75) OVER () AS hi FROM deg)"))
def degree_table(spark, sf):
    return P.degree_table(edges(spark, sf, "supply"), 0.75).select("id", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query()
def far_pairs_biased(spark, sf):
    e = cut(edges(spark, sf, "supply"), "edges")
    near = e.where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return P.sample_far_pairs(ranked(e), 5000, near, cumulative=cut(P.degree_table(e, 0.75), "cum"))


@query(with_edges("basket", UND + _far_sql("5000", "st0") + """, t AS (SELECT u, v, mn::DOUBLE AS h, cnt::DOUBLE AS freq FROM st0 UNION ALL SELECT v, u, mn, cnt FROM st0 UNION ALL SELECT u, v, 100, 1 FROM far UNION ALL SELECT v, u, 100, 1 FROM far) SELECT u, v, sum(h) AS h, sum(freq) AS freq FROM t GROUP BY 1, 2"""))
def add_far_pairs(spark, sf):
    s = und(spark, sf)
    table = P.both_ways(s.select("u", "v", F.col("mn").cast("double").alias("h"), F.col("cnt").cast("double").alias("freq")))
    return P.add_far_pairs(table, P.constant_far_weight(P.sample_far_pairs(ranked(both(spark, sf)), 5000, s)))


@query(with_edges("basket", UND + _far_sql("5000", "(SELECT NULL::BIGINT AS u, NULL::BIGINT AS v)") + " SELECT u, v FROM far WHERE NOT EXISTS (SELECT 1 FROM st0 s WHERE (s.u = far.u AND s.v = far.v) OR (s.u = far.v AND s.v = far.u))"))
def drop_pairs(spark, sf):
    s = und(spark, sf)
    return P.drop_pairs(P.sample_far_pairs(ranked(both(spark, sf)), 5000, s.limit(0)), s)


@query(with_edges("basket", NBR + " SELECT u, v, cnt::DOUBLE AS freq FROM nb"))
def freq_pair(spark, sf):
    return P.freq_pair(P.with_all_neighbours(rows(spark, sf), both(spark, sf))).select("u", "v", "freq")


@query(with_edges("basket", NBR + " SELECT u, v, (sum(cnt) OVER (PARTITION BY v))::DOUBLE AS freq FROM nb"))
def freq_node(spark, sf):
    return P.freq_node(P.with_all_neighbours(rows(spark, sf), both(spark, sf))).select("u", "v", "freq")


# policies
SPEC = {"walks": WALKS, "walk_len": LENGTH, "window": WINDOW, "cap": CAP}
_ROWS = " SELECT u, v, h, freq FROM tb"
#: Walk pairs and the edges they lack.
_WITH_EDGES = ", ce AS MATERIALIZED (SELECT u, v, mn, cnt FROM cp UNION ALL SELECT src, dst, 1, 1 FROM e WHERE src < dst AND NOT EXISTS (SELECT 1 FROM cp WHERE u = src AND v = dst))"


def table_rows(table):
    return table.select("u", "v", F.col("h").cast("double").alias("h"), F.col("freq").cast("double").alias("freq"))


def budget_sql() -> str:
    return "(SELECT " + _BUDGET + "::BIGINT)"


def _policy_sql(stats: str) -> str:
    return _far_sql(budget_sql(), stats) + f""", tb AS MATERIALIZED (SELECT u, v, sum(h)::DOUBLE AS h, sum(freq)::DOUBLE AS freq FROM (SELECT u, v, mn::DOUBLE AS h, cnt::DOUBLE AS freq FROM {stats} UNION ALL SELECT v, u, mn, cnt FROM {stats} UNION ALL SELECT u, v, 100, 1 FROM far UNION ALL SELECT v, u, 100, 1 FROM far) GROUP BY 1, 2)"""


@query(with_edges("basket", CAPPED + _policy_sql("cp") + _ROWS))
def policy_walk(spark, sf):
    return table_rows(A.augment(both(spark, sf), pairs="walk", **SPEC).table)


def walk_edges_sql(cap: int) -> str:
    """The pair table tb of walks with all edges."""
    return capped_sql(cap) + _WITH_EDGES + _policy_sql("ce")


@query(with_edges("basket", walk_edges_sql(CAP) + _ROWS))
def policy_walk_edges(spark, sf):
    return table_rows(A.augment(both(spark, sf), pairs="walk_edges", **SPEC).table)


@query(with_edges("basket", NBR + ", tb AS (SELECT u, v, mn::DOUBLE AS h, cnt::DOUBLE AS freq FROM nb)" + _ROWS))
def policy_nbr_walk(spark, sf):
    return table_rows(A.augment(both(spark, sf), pairs="nbr_walk", **SPEC).table)


@query(with_edges("basket", UND + f""", eu AS (SELECT src AS u, dst AS v FROM e WHERE src < dst), hi AS (SELECT * FROM st0 WHERE mn >= 2), bs AS (SELECT * FROM {_bucket_sql('hi', 'mn', _BUDGET)}),
pr AS (SELECT u, v, mn::DOUBLE AS h, cnt::DOUBLE AS freq FROM bs WHERE NOT EXISTS (SELECT 1 FROM eu WHERE eu.u = bs.u AND eu.v = bs.v) UNION ALL SELECT eu.u, eu.v, 1, coalesce(cnt, 1) FROM eu LEFT JOIN st0 USING (u, v)), tb AS (SELECT u, v, h, freq FROM pr UNION ALL SELECT v, u, h, freq FROM pr)""" + _ROWS))
def policy_buckets(spark, sf):
    return table_rows(A.augment(both(spark, sf), pairs="walk", policy="buckets", **SPEC).table)


@query(with_edges("users", walk_sql(WALKS, LENGTH) + f", rw AS (SELECT start AS u, path[i + 1] AS v, min(i)::BIGINT AS mn, count(*)::BIGINT AS cnt FROM walks, (SELECT unnest(range(1, {LENGTH})) AS i) WHERE path[i + 1] <> start GROUP BY 1, 2)" + _bfs_sql("deg", 8) + """
SELECT count(*)::BIGINT AS n, round(avg((mn = dist)::INT::DOUBLE), 9) AS exact, round(avg((mn > dist)::INT::DOUBLE), 9) AS over, round(avg((mn < dist)::INT::DOUBLE), 9) AS under, round(avg(abs(mn - dist)::DOUBLE), 9) AS mae FROM rw JOIN bfs ON source = u AND node = v"""))
def hop_sample(spark, sf):
    e = cut(edges(spark, sf, "users"), "edges")
    stored = cut(P.row_stats(walks(spark, sf, "users")).select("u", "v", F.col("mn").alias("h")), "stored")
    got = D.hop_sample(D.hop_distance(e, stored.select("u", "v")), stored)
    return got.select("n", *[F.round(c, 9).alias(c) for c in ("exact", "over", "under", "mae")])


