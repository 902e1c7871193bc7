"""Queries on draws of pairs, scores, groups and the store, with DuckDB's forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.rng import below_sql, key_sql
from ..operators import build as K
from ..operators import guards as C
from ..operators import sampling as S
from ..operators import scores as M
from ..sources import store
from ..sources import tables as T
from ..streaming import epochs as ST
from . import protocols as PR
from . import tasks as TK
from .q_forces import KNN, next_vectors
from .q_graph import _bfs_sql, edges, longs, with_edges
from .q_pairs import ranked
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


# draws
@query(with_edges("basket", f" SELECT src AS u, dst AS v FROM e WHERE src < dst ORDER BY {key_sql('pos', 'src', 'dst')}, src, dst LIMIT 2000"))
def positives(spark, sf):
    return S.positives(cut(edges(spark, sf, "basket"), "edges"), 2000)


def _neg_sql(count: int, m: str = "(SELECT count(*) FROM rk)", left: str = "rk") -> str:
    return f""", cd AS MATERIALIZED (SELECT i, {below_sql(m, 'neg', 'i', "'a'")} AS ka, {below_sql('(SELECT count(*) FROM rk)', 'neg', 'i', "'b'")} AS kb FROM (SELECT unnest(range({3 * count + 1024})) AS i) WHERE i < {2 * count + 1024}),
ng AS MATERIALIZED (SELECT i, a.id AS u, b.id AS v FROM cd JOIN {left} a ON a.k = ka JOIN rk b ON b.k = kb WHERE a.id <> b.id AND NOT EXISTS (SELECT 1 FROM e WHERE src = a.id AND dst = b.id) ORDER BY i LIMIT {count})"""


RK = ", rk AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM deg)"


@query(with_edges("basket", RK + _neg_sql(2000) + " SELECT i, u, v FROM ng"))
def negatives(spark, sf):
    e = cut(edges(spark, sf, "basket"), "edges")
    return S.negatives(ranked(e), e, 2000)


@query(with_edges("basket", RK + f", few AS (SELECT id FROM deg ORDER BY {key_sql('source', 'id')}, id LIMIT 50), fk AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM few)" + _neg_sql(1000, "(SELECT count(*) FROM fk)", "fk") + " SELECT i, u, v FROM ng"))
def negatives_sources(spark, sf):
    e = cut(edges(spark, sf, "basket"), "edges")
    return S.pairs_with_sources(ranked(e), e, 1000, 50)


@query(with_edges("basket", RK + f""", cd AS MATERIALIZED (SELECT i, {below_sql('(SELECT count(*) FROM deg)', 'far', 'i', "'a'")} AS ka, {below_sql('(SELECT count(*) FROM deg)', 'far', 'i', "'b'")} AS kb FROM (SELECT unnest(range(5024)) AS i)),
ca AS (SELECT least(a.id, b.id) AS u, greatest(a.id, b.id) AS v, min(i) AS i FROM cd JOIN rk a ON a.k = ka JOIN rk b ON b.k = kb WHERE a.id <> b.id GROUP BY 1, 2) SELECT u, v FROM ca WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = u AND dst = v) ORDER BY i LIMIT 2000"""))
def distinct_negatives(spark, sf):
    e = cut(edges(spark, sf, "basket"), "edges")
    return S.distinct_negatives(ranked(e), e, 2000)


@query(with_edges("users", _bfs_sql("deg", 8) + f", n AS (SELECT count(DISTINCT dist) AS k FROM bfs WHERE dist > 0), r AS (SELECT source AS u, node AS v, dist AS hops, row_number() OVER (PARTITION BY dist ORDER BY {key_sql('hop', 'source', 'node')}, source, node) AS r FROM bfs WHERE dist > 0) SELECT u, v, hops FROM r, n WHERE r <= 300 // k"))
def stratified_by_hop(spark, sf):
    from ..operators.paths import pairs_and_totals

    pairs, totals = pairs_and_totals(cut(edges(spark, sf, "users"), "edges"))
    return longs(S.stratified(pairs.withColumnRenamed("h", "hops"), 300, totals=totals), "u", "v", "hops")


@query(with_edges("basket", f", ps AS (SELECT src AS u, dst AS v, 1 AS y FROM e WHERE src < dst), x AS (SELECT u, v, y::BIGINT AS y, percent_rank() OVER (PARTITION BY y ORDER BY {key_sql('split', 'u', 'v')}, u, v) < 0.2 AS test FROM ps) SELECT u, v, y, test FROM x"))
def train_test_split(spark, sf):
    e = edges(spark, sf, "basket").where("src < dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).cast("long").alias("y"))
    return S.train_test(e, "y")


@query(f"SELECT b, i, {below_sql('100', 'boot', 'b', 'i')} AS k FROM (SELECT unnest(range(20)) AS b), (SELECT unnest(range(100)) AS i)")
def bootstrap_index(spark, sf):
    return longs(S.bootstrap_index(100, 20, spark), "b", "i", "k")


# scores: distances x of neighbouring vectors against y, the difference of their labels and one
XY = "WITH z AS MATERIALIZED (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings), xy AS MATERIALIZED (SELECT a.id AS u, b.id AS v, round(list_distance(a.vec, b.vec), 3) AS x, (1 + abs(a.label - b.label))::DOUBLE AS y FROM z a JOIN z b ON b.id BETWEEN a.id + 1 AND a.id + 5)"


def xy(spark, sf):
    z = T.vectors(spark, sf)
    d = V.distance(next_vectors(spark, sf), z)
    lab = z.select("id", "label")
    d = d.join(lab.select(F.col("id").alias("u"), F.col("label").alias("lu")), "u").join(lab.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v")
    return cut(d.select("u", "v", F.round("dist", 3).alias("x"), (1 + F.abs(F.col("lu") - F.col("lv"))).cast("double").alias("y")), "xy")


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


MID = ", rk AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM xy)"


@query(XY + MID + " SELECT u, v, rx::DOUBLE AS rx FROM rk")
def midranks(spark, sf):
    return M.midranks(xy(spark, sf), "x", "rx").select("u", "v", F.col("rx").cast("double").alias("rx"))


@query(XY + MID + " SELECT round(corr(rx, ry), 6) AS rho FROM rk")
def spearman(spark, sf):
    return rounded(M.spearman(xy(spark, sf)))


_CD = """, ab AS (SELECT a.x AS x1, b.x AS x2, a.y AS y1, b.y AS y2 FROM xy a JOIN xy b ON (a.u, a.v) < (b.u, b.v)),
k AS (SELECT count(*)::DOUBLE AS n0, sum(((x1 - x2) * (y1 - y2) > 0)::INT)::DOUBLE AS c, sum(((x1 - x2) * (y1 - y2) < 0)::INT)::DOUBLE AS d, sum((x1 = x2)::INT)::DOUBLE AS tx, sum((y1 = y2)::INT)::DOUBLE AS ty FROM ab)"""


@query(XY + _CD + " SELECT round((c - d) / sqrt((n0 - tx) * (n0 - ty)), 6) AS tau_b FROM k")
def kendall_tau_b(spark, sf):
    return rounded(M.kendall_tau_b(xy(spark, sf)))


@query(XY + _CD + " SELECT round((c - d) / (n0 - tx), 6) AS somers_d FROM k")
def somers_d(spark, sf):
    return rounded(M.somers_d(xy(spark, sf)))


_TIE = "sum(t * (t - 1)) / (sum(t) * (sum(t) - 1))"


@query(XY + f" SELECT round({_TIE}, 6) AS tie_frac FROM (SELECT count(*)::DOUBLE AS t FROM xy GROUP BY y)")
def tie_frac(spark, sf):
    return rounded(M.tie_frac(xy(spark, sf)))


@query(XY + f" SELECT round(sqrt(1 - {_TIE}), 6) AS tau_b_max FROM (SELECT count(*)::DOUBLE AS t FROM xy GROUP BY y)")
def tau_b_max(spark, sf):
    return rounded(M.tau_b_max(xy(spark, sf)))


_SHELL = XY + """, hs AS (SELECT y AS h, lag(y) OVER (ORDER BY y) AS b FROM (SELECT DISTINCT y FROM xy)),
cu AS (SELECT h, x, y FROM hs JOIN xy ON y <= h), cr AS (SELECT *, rank() OVER (PARTITION BY h ORDER BY x) + (count(*) OVER (PARTITION BY h, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY h ORDER BY y) + (count(*) OVER (PARTITION BY h, y) - 1) / 2.0 AS ry FROM cu), c AS (SELECT h, corr(rx, ry) AS rho FROM cr GROUP BY h),
su AS (SELECT h, x, y FROM hs JOIN xy ON y = h OR y = b), sr AS (SELECT *, rank() OVER (PARTITION BY h ORDER BY x) + (count(*) OVER (PARTITION BY h, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY h ORDER BY y) + (count(*) OVER (PARTITION BY h, y) - 1) / 2.0 AS ry FROM su), s AS (SELECT h, corr(rx, ry) AS rho, corr(x, y) ** 2 AS r2 FROM sr GROUP BY h),
g AS (SELECT y AS h, count(*)::BIGINT AS n, avg(x) AS m, stddev_pop(x) AS sd FROM xy GROUP BY y),
shells AS (SELECT h, n, CASE WHEN b IS NOT NULL THEN round(c.rho, 6) END AS rho_cum, CASE WHEN b IS NOT NULL THEN round(s.rho, 6) END AS rho_shell, round(m, 6) AS x_mean, round(sd, 6) AS x_std, CASE WHEN b IS NOT NULL THEN round(r2, 6) END AS r2_shell FROM hs JOIN c USING (h) JOIN s USING (h) JOIN g USING (h))"""


@query(_SHELL + " SELECT * FROM shells")
def per_shell(spark, sf):
    s = M.per_shell(xy(spark, sf))
    return s.select("h", "n", *[F.round(c, 6).alias(c) for c in ("rho_cum", "rho_shell", "x_mean", "x_std", "r2_shell")])


@query(_SHELL + " SELECT max(h) AS h_star FROM shells WHERE rho_cum >= (SELECT max(rho_cum) FROM shells) - 0.02")
def h_star(spark, sf):
    return M.h_star(M.per_shell(xy(spark, sf)))


_SCALE = ", k AS (SELECT sum(x * y) / sum(x * x) AS s, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM xy)"


@query(XY + _SCALE + " SELECT round(s, 6) AS scale, round(sqrt((s * s * xx - 2 * s * xy + yy) / yy), 6) AS stress1 FROM k")
def stress1(spark, sf):
    return rounded(M.stress1(xy(spark, sf)))


@query(XY + ", d AS (SELECT greatest(4.0 * x / y, y / greatest(4.0 * x, 2.220446049250313e-16)) AS d FROM xy) SELECT round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(quantile_cont(d, 0.99), 6) AS p99 FROM d")
def distortion(spark, sf):
    return rounded(M.distortion(xy(spark, sf), 4.0))


@query(XY + """, per AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(w * m) OVER (ORDER BY i) AS cs FROM (SELECT x, avg(y::DOUBLE) AS m, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY x) AS i FROM xy GROUP BY x)),
win AS (SELECT a.i AS j, b.i, min((b.cs - a.cs + a.w * a.m) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS v FROM per a JOIN per b ON a.i <= b.i),
fit AS (SELECT per.i, any_value(w) AS w, max(v) AS f FROM win JOIN per ON per.i = win.i GROUP BY per.i), a AS (SELECT count(*) AS n, avg(y::DOUBLE) AS mean, var_pop(y::DOUBLE) AS var FROM xy), top AS (SELECT max(f) - 0.02 AS t FROM fit)
SELECT round(sum(w * (f - mean) * (f - mean)) / any_value(n) / any_value(var), 6) AS isotonic_r2, round(min(CASE WHEN f >= t THEN f END), 6) AS h_star, round(sum(CASE WHEN f >= t THEN w ELSE 0 END) / any_value(n), 6) AS share FROM fit, a, top""")
def isotonic_fit(spark, sf):
    f = M.isotonic_fit(xy(spark, sf))
    return spark.createDataFrame([(round(f["isotonic_r2"], 6), round(f["h_star"], 6), round(f["share"], 6))], "isotonic_r2 double, h_star double, share double")


@query(XY + ", n AS (SELECT ceil(count(*) / 200.0)::BIGINT AS stride FROM xy), r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS p FROM xy) SELECT x FROM r, n WHERE p % stride = 0")
def shepard_pairs(spark, sf):
    return M.shepard_pairs(xy(spark, sf), 200).select("x")


@query()
def bootstrap_ci(spark, sf):
    return M.bootstrap(xy(spark, sf).select("x", "y"), lambda d: d["x"].rank().corr(d["y"].rank()), 100)


_LAB = XY + ", s AS (SELECT (y = 1)::INT AS y, (x < 1.2)::INT AS pred, -x AS prob FROM xy)"


def scored(spark, sf):
    return cut(xy(spark, sf).select((F.col("y") == 1).cast("int").alias("y"), (F.col("x") < 1.2).cast("int").alias("pred"), (-F.col("x")).alias("prob")), "scored")


@query(_LAB + """, r AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM s),
k AS (SELECT sum((y = 1 AND pred = 1)::INT)::DOUBLE AS tp, sum((y = 0 AND pred = 1)::INT)::DOUBLE AS fp, sum((y = 1 AND pred = 0)::INT)::DOUBLE AS fn, sum((y = pred)::INT)::DOUBLE AS ok, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS p, sum(CASE WHEN y = 1 THEN r END)::DOUBLE AS rs FROM r)
SELECT round(ok / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1_score, round((rs - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc FROM k""")
def classify_scores(spark, sf):
    return rounded(M.classify_scores(scored(spark, sf)))


@query(XY + ", e AS (SELECT 4.0 * x - y AS e, y, 4.0 * x AS p FROM xy) SELECT round(avg(abs(e)), 6) AS mae, round(avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mre, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(avg((round_even(p, 0) = y)::INT::DOUBLE), 6) AS exact FROM e")
def regress_scores(spark, sf):
    return rounded(M.regress_scores(xy(spark, sf).withColumn("pred", 4.0 * F.col("x"))))


@query(_LAB + ", g AS (SELECT prob, sum(y)::DOUBLE AS tp, count(*)::DOUBLE AS m FROM s GROUP BY prob), c AS (SELECT *, sum(tp) OVER (ORDER BY prob DESC) AS ctp, sum(m) OVER (ORDER BY prob DESC) AS cm FROM g) SELECT round(sum(tp * ctp / cm) / sum(tp), 6) AS ap FROM c")
def link_rank_ap(spark, sf):
    return rounded(M.average_precision(scored(spark, sf).withColumnRenamed("prob", "score")))


# neighbours and groups
_TRUE = KNN + ", e AS MATERIALIZED (SELECT DISTINCT id AS src, neighbour AS dst FROM (SELECT id, neighbour FROM near WHERE rank <= 5 UNION ALL SELECT neighbour, id FROM near WHERE rank <= 5))"


def near_and_edges(spark, sf):
    z = T.vectors(spark, sf)
    near = cut(K.knn_exact(z, 10), "near")
    return near, cut(K.make_graph(z, "knn", k=5), "edges")


@query(_TRUE + ", m AS (SELECT src, least(count(*), 10) AS m FROM e GROUP BY src) SELECT round((SELECT count(*) FROM near WHERE EXISTS (SELECT 1 FROM e WHERE src = id AND dst = neighbour))::DOUBLE / (SELECT sum(m) FROM m), 6) AS recall")
def recall_at_10(spark, sf):
    return rounded(M.recall_at(*near_and_edges(spark, sf)))


@query(_TRUE + """, h AS (SELECT id, rank, EXISTS (SELECT 1 FROM e WHERE src = id AND dst = neighbour)::INT AS hit FROM near), c AS (SELECT *, sum(hit) OVER (PARTITION BY id ORDER BY rank) AS upto FROM h),
p AS (SELECT id, sum(hit) AS hits, max(CASE WHEN hit = 1 THEN 1.0 / rank END) AS rr, sum(CASE WHEN hit = 1 THEN upto::DOUBLE / rank END) AS ap FROM c GROUP BY id), dg AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY src)
SELECT round(avg(coalesce(hits, 0) / 10.0::DOUBLE), 6) AS precision, round(avg(coalesce(hits, 0)::DOUBLE / least(deg, 10)), 6) AS recall, round(avg(coalesce(rr, 0)::DOUBLE), 6) AS mrr, round(avg(coalesce(ap, 0) / least(deg, 10)), 6) AS map, round(avg((coalesce(hits, 0) > 0)::INT::DOUBLE), 6) AS hits_at_k FROM dg LEFT JOIN p USING (id)""")
def retrieval_at_k(spark, sf):
    return rounded(M.retrieval(*near_and_edges(spark, sf)))


@query(KNN + ", c AS (SELECT a.id, b.id AS neighbour, 1 - list_inner_product(a.vec, b.vec) / greatest(sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec)), 1e-12) AS dist FROM z a JOIN z b ON a.id <> b.id), nc AS (SELECT id, neighbour FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, neighbour) AS r FROM c) WHERE r <= 10), i AS (SELECT id, count(*) AS k FROM near JOIN nc USING (id, neighbour) GROUP BY id) SELECT round(avg(coalesce(k, 0)::DOUBLE / (20 - coalesce(k, 0))), 6) AS jaccard FROM (SELECT DISTINCT id FROM near) LEFT JOIN i USING (id)")
def knn_jaccard(spark, sf):
    z = T.vectors(spark, sf)
    return rounded(M.knn_overlap(K.knn_exact(z, 10), K.knn_exact(z, 10, "cosine")))


_AB = "WITH t AS MATERIALIZED (SELECT event_type AS a, extract(hour FROM ts)::BIGINT AS b, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"


def groups(spark, sf):
    return T.table(spark, sf, "events").select(F.col("event_type").alias("a"), F.hour("ts").cast("long").alias("b"))


@query(_AB + " SELECT a, b, n FROM t")
def contingency(spark, sf):
    return M.contingency(groups(spark, sf))


@query(_AB + ", k AS (SELECT sum(n) AS n, sum(n * ln(n)) AS s FROM t), ha AS (SELECT sum(m * ln(m)) AS s FROM (SELECT sum(n) AS m FROM t GROUP BY a)), hb AS (SELECT sum(m * ln(m)) AS s FROM (SELECT sum(n) AS m FROM t GROUP BY b)), h AS (SELECT ln(k.n) - ha.s / k.n AS a, ln(k.n) - hb.s / k.n AS b, ln(k.n) - k.s / k.n AS ab FROM k, ha, hb) SELECT round(2 * (a + b - ab) / (a + b), 6) AS nmi FROM h")
def nmi(spark, sf):
    return rounded(M.nmi(groups(spark, sf)))


@query(_AB + ", k AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS p FROM t), pa AS (SELECT sum(m * (m - 1) / 2) AS p FROM (SELECT sum(n) AS m FROM t GROUP BY a)), pb AS (SELECT sum(m * (m - 1) / 2) AS p FROM (SELECT sum(n) AS m FROM t GROUP BY b)) SELECT round((k.p - pa.p * pb.p / (k.n * (k.n - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (k.n * (k.n - 1) / 2)), 6) AS ari FROM k, pa, pb")
def ari(spark, sf):
    return rounded(M.ari(groups(spark, sf)))


# guards, protocols and the store
@query("SELECT count(*)::BIGINT AS n, 0::BIGINT AS not_finite, sum((list_max(list_transform(embedding, lambda x: abs(x))) = 0)::INT)::BIGINT AS zero, round(max(sqrt(list_inner_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE)))), 6) AS max_norm FROM embeddings")
def guards(spark, sf):
    return C.bad_rows(T.vectors(spark, sf)).select("n", "not_finite", "zero", F.round("max_norm", 6).alias("max_norm"))


def runs(spark, sf):
    """Events as runs: type as graph, day of the month as method, user as seed."""
    return T.table(spark, sf, "events").select(F.col("event_type").alias("graph"), F.dayofmonth("ts").cast("string").alias("method"), F.col("user_id").cast("long").alias("seed"), F.struct("ts", "event_id").alias("stamp"), F.col("value").alias("value"))


_RUNS = "WITH runs AS (SELECT event_type AS graph, extract(day FROM ts)::VARCHAR AS method, user_id::BIGINT AS seed, ts, event_id, value FROM events), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph, method, seed ORDER BY ts DESC, event_id DESC) AS r FROM runs) WHERE r = 1)"


@query(_RUNS + " SELECT graph, method, seed, value FROM last")
def run_dedup(spark, sf):
    return store.latest(runs(spark, sf)).select("graph", "method", "seed", "value")


@query(_RUNS + ", g AS (SELECT graph, method, count(value)::BIGINT AS n, avg(value) AS mean, stddev_pop(value) AS std FROM last GROUP BY graph, method) SELECT graph, method, n, round(mean, 6) AS mean, round(std, 6) AS std, row_number() OVER (PARTITION BY graph ORDER BY mean DESC NULLS LAST, method) AS place FROM g")
def report_mean_std(spark, sf):
    return store.table(store.latest(runs(spark, sf)), "value").select("graph", "method", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.col("place").cast("long").alias("place"))


@query(_RUNS + " SELECT graph, method, count(DISTINCT seed)::BIGINT AS n_seeds FROM runs GROUP BY ALL")
def seed_census(spark, sf):
    return store.census(runs(spark, sf))


# models and whole runs: no SQL form
def _z(spark, sf):
    from ..operators import baselines as B

    e = cut(edges(spark, sf, "basket"), "edges")
    return e, cut(B.random_projection(e, 8), "z")


def _told(spark, result):
    from .report import flatten

    rows = [(k, float(v)) for k, v in flatten(result.scores).items() if isinstance(v, (int, float))]
    return spark.createDataFrame(rows, "score string, value double")


@query()
def link_prediction_rf(spark, sf):
    e, z = _z(spark, sf)
    return _told(spark, TK.link_prediction(e, z, PR.LinkPrediction(), 42, False))


@query()
def dist_approx_rf(spark, sf):
    e, z = _z(spark, sf)
    return _told(spark, TK.dist_approx(e, z, PR.DistanceApproximation(), 42, False))


@query()
def kmeans_communities(spark, sf):
    z = T.vectors(spark, sf)
    return TK.kmeans_labels(z, 10)


@query()
def procrustes(spark, sf):
    z = T.vectors(spark, sf).select("id", F.slice("vec", 1, 8).alias("vec"))
    turned = z.select("id", F.concat(F.transform(F.slice("vec", 2, 1), lambda x: -x), F.slice("vec", 1, 1), F.slice("vec", 3, 6)).alias("vec"))
    return spark.createDataFrame([(round(M.procrustes_rms(z, turned, 8), 6),)], "rms double")


@query()
def stream_epoch(spark, sf):
    z, _ = ST.run(cut(edges(spark, sf, "users"), "edges"), 1, 2, d=4, n_walks=2, length=5)
    return z
