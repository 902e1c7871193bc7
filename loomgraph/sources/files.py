"""Readers and writers of graph, embedding and record files.

Text formats go through Spark's text source, so a file of any size is split among tasks.  Formats that only NumPy reads
(.npz, .npy) and small JSON records are fetched whole to the driver, from any store Spark reads; they are meant for small
inputs.
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def get_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A whole small file of any store; None if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file to any store; folders are made on the way."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def _arrays(spark: SparkSession, path: str):
    data = get_bytes(spark, path)
    if data is None:
        raise FileNotFoundError(path)
    return np.load(io.BytesIO(data))


def citation_edges(spark: SparkSession, path: str) -> DataFrame:
    """White-space pairs of integer paper ids."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where(F.length(F.trim("value")) > 0).select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"))


def named_edges(spark: SparkSession, path: str) -> DataFrame:
    """White-space pairs of ids that stay text."""
    f = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where(F.length(F.trim("value")) > 0).select(f[0].alias("src"), f[1].alias("dst"))


def paper_edges(spark: SparkSession, path: str, header: int = 2) -> DataFrame:
    """Tab fields 1 and 3 are ``paper:<id>``; the first lines are a header and carry no such field."""
    f = F.split("value", "\t")
    ok = _lines(spark, path).where((F.size(f) > 3) & f[1].startswith("paper:") & f[3].startswith("paper:"))
    return ok.select(F.split(f[1], ":")[1].cast("long").alias("src"), F.split(f[3], ":")[1].cast("long").alias("dst"))


def tabbed_edges(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated integers, # comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema="src long, dst long")


def noun_pointers(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon data file: a line has an offset, a hexadecimal word count, words, a pointer count and pointers of four fields.

    Pointers @ and @i lead from a child to its parent.  Lines that begin with two blanks are the licence.
    """
    line = _lines(spark, path).where(~F.col("value").startswith("  ")).select(F.split(F.split("value", r"\|")[0], " ").alias("f"))
    words = F.conv(F.col("f")[3], 16, 10).cast("int")
    count = F.element_at("f", 4 + 2 * words + 1).cast("int")
    at = F.sequence(F.lit(0), count - 1)
    p = line.withColumn("base", 4 + 2 * words + 2).withColumn("count", count).where("count > 0")
    p = p.withColumn("ptr", F.explode(F.transform(at, lambda i: F.slice("f", F.col("base") + 4 * i, F.lit(4)))))
    return p.where(F.col("ptr")[0].isin("@", "@i")).select(F.col("f")[0].cast("long").alias("src"), F.col("ptr")[1].cast("long").alias("dst"))


def taxonomy_edges(spark: SparkSession, path: str) -> DataFrame:
    """Fields split by tab, bar, tab: child and parent; the root's own line goes."""
    f = F.split("value", r"\t\|\t", 3)
    return _lines(spark, path).select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst")).where("src <> dst")


READERS: dict[str, Callable] = {"citation": citation_edges, "named": named_edges, "papers": paper_edges, "tabbed": tabbed_edges, "nouns": noun_pointers, "taxonomy": taxonomy_edges}


# Public graphs by name, the format of each and its usual place under a data folder.
REGISTRY = {
    "cora": ("citation", "cora/cora.cites"),
    "citeseer": ("named", "citeseer/citeseer.cites"),
    "pubmed": ("papers", "pubmed/Pubmed-Diabetes.DIRECTED.cites.tab"),
    "com_youtube": ("tabbed", "com_youtube/com-youtube.ungraph.txt"),
    "as_skitter": ("tabbed", "as_skitter/as-skitter.txt"),
    "roadnet_ca": ("tabbed", "roadnet_ca/roadNet-CA.txt"),
    "wordnet": ("nouns", "wordnet/data.noun"),
    "ncbi_taxonomy": ("taxonomy", "ncbi_taxonomy/nodes.dmp"),
}
#: Where the registry's files lie, unless a caller says otherwise.
DATA = os.environ.get("LOOMGRAPH_DATA", "data")
#: Of these formats edges lead from child to parent; they are cut to a subtree, not to a ball.
TREES = ("nouns", "taxonomy")


def read_edges(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in READERS:
        raise KeyError(f"unknown format {name!r}; there are {', '.join(sorted(READERS))}")
    return READERS[name](spark, path)


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """First two columns, split by white space or commas, whichever the first line that isn't a comment has."""
    lines = _lines(spark, path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0))
    head = lines.head(1)
    sep = r"\s*,\s*" if head and "," in head[0][0] else r"\s+"
    f = F.split(F.trim("value"), sep)
    return lines.select(f[0].cast("double").cast("long").alias("src"), f[1].cast("double").cast("long").alias("dst"))


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates of a Matrix Market file from 1; % lines and the size line go.

    Of a folder's files the one that has the banner has the size line: Spark reads the largest file first, not the first.
    """
    raw = _lines(spark, path)
    content = ~F.col("value").startswith("%") & (F.length(F.trim("value")) > 0)
    led = raw.where(F.lower("value").startswith("%%matrixmarket")).select(F.col("_metadata.file_path").alias("path")).head(1)
    lines = raw.where(content)
    head = (lines.where(F.col("_metadata.file_path") == led[0].path) if led else lines).head(1)
    f = F.split(F.trim("value"), r"\s+")
    body = lines
    if head and len(head[0][0].split()) == 3:
        is_size = F.col("value") == head[0][0]
        same = lines.where(is_size).count() - 1  # entries with a value may look like the size line: only one line goes
        body = lines.where(~is_size)
        if same:
            body = body.union(spark.range(same).select(F.lit(head[0][0]).alias("value")))
    return body.select((f[0].cast("long") - 1).alias("src"), (f[1].cast("long") - 1).alias("dst"))


def npz_graph(spark: SparkSession, path: str) -> DataFrame:
    """``edges`` (m, 2), ``A`` (dense) or a compressed sparse row triple."""
    with _arrays(spark, path) as f:
        if "edges" in f:
            e = f["edges"]
        elif "A" in f:
            e = np.argwhere(f["A"])
        else:
            ptr, idx = f["indptr"], f["indices"]
            e = np.stack([np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), idx], axis=1)
    return spark.createDataFrame([(int(a), int(b)) for a, b in e], "src long, dst long")


def write_matrix_market(edges: DataFrame, n: int, path: str) -> None:
    """The upper triangle, ids from 1, as one Matrix Market pattern; the body is written by Spark, then led by a header."""
    upper = edges.where("src < dst").select((F.col("dst") + 1).alias("a"), (F.col("src") + 1).alias("b"))
    count = upper.count()
    head = edges.sparkSession.createDataFrame([(0, 0, f"%%MatrixMarket matrix coordinate pattern symmetric\n{n} {n} {count}")], "a long, b long, value string")
    body = upper.select("a", "b", F.concat_ws(" ", "a", "b").alias("value"))
    head.unionByName(body).repartitionByRange(1 if count < 1_000_000 else 200, "a", "b").sortWithinPartitions("a", "b").select("value").write.mode("overwrite").text(path)


def embedding_csv(spark: SparkSession, path: str, sep: str = ",", nodes: DataFrame | None = None) -> DataFrame:
    """id, vec.  The first column is the id if it is whole and unique; nodes without a row get zeros."""
    raw = spark.read.csv(path, sep=sep, inferSchema=True, comment="#")
    first = raw.columns[0]
    total, whole, kinds = raw.agg(F.count(F.lit(1)), F.sum((F.col(first) == F.floor(first)).cast("int")), F.countDistinct(first)).first()
    has_id = total == whole == kinds
    cols = raw.columns[1:] if has_id else raw.columns
    ids = F.col(first).cast("long") if has_id else F.monotonically_increasing_id()
    z = raw.select(ids.alias("id"), F.array(*[F.col(c).cast("float") for c in cols]).alias("vec"))
    return with_zero_rows(z, nodes, len(cols)) if nodes is not None else z


def with_zero_rows(z: DataFrame, nodes: DataFrame, d: int) -> DataFrame:
    """A row for each node; those without a vector get zeros."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), d)
    return nodes.select("id").join(z, "id", "left").select("id", F.coalesce("vec", zero).alias("vec"))


def _text_vectors(spark: SparkSession, path: str, base: int) -> tuple[DataFrame, int, int]:
    lines = _lines(spark, path)
    count, d = (int(x) for x in lines.head(1)[0][0].split()[:2])
    f = F.split(F.trim("value"), r"\s+")
    body = lines.where((F.size(f) == d + 1) & ((F.size(f) != 2) | (F.col("value") != f"{count} {d}")))
    z = body.select((f[0].cast("long") - base).alias("id"), F.slice(f, 2, d).cast("array<float>").alias("vec"))
    return z, count, d


def embedding_w2v(spark: SparkSession, path: str, nodes: DataFrame | None = None) -> DataFrame:
    """``count dim`` and then ``id v1 .. vd``; ids beyond the nodes are left out, nodes without a row get zeros."""
    z, _, d = _text_vectors(spark, path, 0)
    return with_zero_rows(z, nodes, d) if nodes is not None else z


def embedding_embd(spark: SparkSession, path: str, n: int, dim: int) -> DataFrame:
    """The same text form with ids from 1; another dimension than asked for raises."""
    z, _, d = _text_vectors(spark, path, 1)
    if d != dim:
        raise ValueError(f"the file has {d} dimensions, not {dim}")
    return with_zero_rows(z, spark.range(n), d)


def embedding_npz(spark: SparkSession, path: str) -> DataFrame:
    """Key ``Z``, or the only key there is."""
    with _arrays(spark, path) as f:
        z = f["Z"] if "Z" in f else f[f.files[0]]
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(z)], "id long, vec array<float>")


def load_graph(spark: SparkSession, src, fmt: str | None = None, max_nodes: int = 0, seed: int = 42, data: str | None = None) -> tuple[DataFrame, dict]:
    """A DataFrame, a registry name, a file by its ending, or a file of a named format -> symmetric edges and facts.

    With max_nodes a graph is cut to the ball of so many nodes round a drawn start, a tree to a subtree.
    """
    from ..operators import graph as G

    if not isinstance(src, DataFrame) and not fmt and src in REGISTRY:
        fmt, at = REGISTRY[src]
        src = f"{data or DATA}/{at}"
    if isinstance(src, DataFrame):
        raw, name = src, "dataframe"
    elif fmt:
        raw, name = read_edges(spark, fmt, src), src
    elif str(src).endswith(".npz"):
        raw, name = npz_graph(spark, src), src
    elif str(src).endswith(".mtx"):
        raw, name = matrix_market(spark, src), src
    elif str(src).endswith(".parquet"):
        raw, name = spark.read.parquet(src), src
    else:
        raw, name = edge_list(spark, src), src
    if max_nodes and fmt in TREES:
        raw = G.subtree(raw, max_nodes, seed)
    e = G.symmetric(raw)
    if max_nodes and fmt not in TREES:
        e = G.ball(e, max_nodes, seed)
    n, m = G.nodes_of(e).count(), e.where("src < dst").count()
    return e, {"source": str(name), "n": n, "n_edges": m, "avg_degree": 2 * m / n if n else 0.0}


def load_embedding(spark: SparkSession, src, nodes: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """A DataFrame (id, vec) or a file by its ending; the facts count rows of zeros."""
    if isinstance(src, DataFrame):
        z = src
    elif str(src).endswith((".npz", ".npy")):
        z = embedding_npz(spark, src) if str(src).endswith(".npz") else spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(_arrays(spark, src))], "id long, vec array<float>")
    elif str(src).endswith((".csv", ".tsv")):
        z = embedding_csv(spark, src, "\t" if str(src).endswith(".tsv") else ",", nodes)
    elif str(src).endswith(".parquet"):
        z = spark.read.parquet(src)
    else:
        z = embedding_w2v(spark, src, nodes)
    rows, zero, d = z.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.forall("vec", lambda x: x == 0).cast("int")), F.lit(0)), F.max(F.size("vec"))).first()
    return z, {"n": rows, "n_dim": d, "zero_rows": zero}


def write_walks(walks: DataFrame, path: str) -> None:
    """One walk a line, nodes split by blanks."""
    walks.select(F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def graph_hash(edges: DataFrame) -> str:
    """A key of the edge set that doesn't depend on order."""
    n, s, x = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("dst", "src"))).first()
    return f"{n:x}-{int(s or 0) & (2**64 - 1):016x}-{int(x or 0) & (2**64 - 1):016x}"


def write_profile(edges: DataFrame, profile: dict, folder: str) -> str:
    path = f"{folder}/{graph_hash(edges)}.json"
    put_bytes(edges.sparkSession, path, json.dumps(profile).encode())
    return path


def read_profile(edges: DataFrame, folder: str) -> dict | None:
    data = get_bytes(edges.sparkSession, f"{folder}/{graph_hash(edges)}.json")
    return None if data is None else json.loads(data)


def read_context(path: str) -> dict:
    data = get_bytes(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), str(path))
    if data is None:
        raise FileNotFoundError(path)
    return json.loads(data)


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """``RESULT`` lines of tab-separated k=v fields as maps."""
    lines = _lines(spark, path).where(F.col("value").startswith("RESULT\t"))
    return lines.select(F.str_to_map(F.expr("substring(value, 8)"), F.lit("\t"), F.lit("=")).alias("fields"))


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """name, value of each ``name: number`` in a log."""
    got = _lines(spark, path).select(F.expr(r"regexp_extract_all(value, '([A-Za-z_]\\w*)\\s*[:=]\\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)', 0)").alias("m")).select(F.explode("m").alias("m"))
    return got.select(F.trim(F.split("m", "[:=]")[0]).alias("name"), F.trim(F.split("m", "[:=]")[1]).cast("double").alias("value"))


def last_stage(spark: SparkSession, path: str, stages: list[str]) -> str | None:
    """The last of the named stages a log mentions."""
    rank = {s: i for i, s in enumerate(stages)}
    got = _lines(spark, path).select(F.explode(F.array(*[F.when(F.col("value").contains(s), F.lit(i)) for s, i in rank.items()])).alias("i")).agg(F.max("i")).first()[0]
    return None if got is None else stages[got]


def swiss_roll(spark: SparkSession, n: int = 1500, seed: int = 0) -> DataFrame:
    """id, vec (3), target: a rolled-up plane."""
    from ..functions.rng import u01

    t = F.lit(4.71238898038469) * (1 + 2 * u01("roll", F.col("id"), 0, seed=seed))
    return spark.range(n).select("id", F.array(t * F.cos(t), 21 * u01("roll", F.col("id"), 1, seed=seed), t * F.sin(t)).alias("vec"), t.alias("target"))


def s_curve(spark: SparkSession, n: int = 1500, seed: int = 0) -> DataFrame:
    from ..functions.rng import u01

    t = F.lit(9.42477796076938) * (u01("curve", F.col("id"), 0, seed=seed) - 0.5)
    return spark.range(n).select("id", F.array(F.sin(t), 2 * u01("curve", F.col("id"), 1, seed=seed), F.signum(t) * (F.cos(t) - 1)).alias("vec"), t.alias("target"))


def clusters(spark: SparkSession, n: int = 1500, centres: int = 5, seed: int = 0) -> DataFrame:
    """id, vec (3), target: normal clouds about random centres."""
    from ..functions.rng import normal, u01

    k = F.pmod("id", F.lit(centres))
    return spark.range(n).select("id", F.array(*[20 * u01("centre", k, i, seed=seed) - 10 + normal("cloud", F.col("id"), i, seed=seed) for i in range(3)]).alias("vec"), k.cast("double").alias("target"))


def closed_curve(spark: SparkSession, n: int = 1500, seed: int = 0, harmonics: int = 4) -> DataFrame:
    """id, vec (3), target: points on a curve given by a few Fourier terms, the third axis a second such curve."""
    from ..functions.rng import u01

    t = F.lit(6.283185307179586) * u01("curve3", F.col("id"), seed=seed)
    wave = lambda phase: sum((F.cos(t * k + phase * k) / k for k in range(1, harmonics + 1)), F.lit(0.0))
    return spark.range(n).select("id", F.array(wave(0.0), wave(1.0), wave(2.0)).alias("vec"), t.alias("target"))


def preferential(spark: SparkSession, n: int, m: int = 3, seed: int = 42) -> DataFrame:
    """Preferential attachment: a path on m + 1 nodes, then each new node joins m different ones by degree.

    Each step needs the degrees left by the one before, so the draw runs on the driver.
    """
    rng = np.random.default_rng(seed)
    ends = [x for i in range(m) for x in (i, i + 1)]
    edges = [(i, i + 1) for i in range(m)]
    for new in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(ends[int(rng.integers(len(ends)))])
        for c in sorted(chosen):
            edges.append((new, c))
            ends += [new, c]
    return spark.createDataFrame(edges, "src long, dst long")
