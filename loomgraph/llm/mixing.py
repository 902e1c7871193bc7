"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; all targets sum to all sizes; a target stops
at ``stop`` times its source's size and the excess is shared again by weight.

Within a source longer documents are worth more, up to a point: a document's merit is size / (size + ``HALF``).  It
expects ``ratio * (1 + lean * (merit - mean merit))`` copies, where ratio is target over size and the mean is weighted by
size, so that the expected words add up to the target; lean is 1, or less where else a document would pass ``stop``
copies.  The whole copies are certain.  The rest is a probability of one more copy, different from document to document:
documents are ranked by random odds over these inclusion odds (Pareto order sampling) and taken in that order until the
target's words are reached, to the nearest document.

The running sum per source is never made in one task: documents fall into ``BINS`` bins of their rank value, those of
the bin that holds the cut into ``BINS`` finer ones, and only the finer bin that holds it is put in order.

Defined results: null text has size 0; a source of size 0 has target 0; a document of size 0 is taken as 0 words; the
random number depends on doc_id alone, so reruns agree, and rows that repeat an id with texts of one size stand or fall
together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BINS = 4096
#: Words at which a document has half the greatest merit, and the unit that merits are counted in.
HALF, UNIT = 200, 1_000_000


def uniform(seed: str = "mix") -> Column:
    """In (0, 1), from the id alone."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def merit(size: Column) -> Column:
    """In whole units, so that sums don't depend on their order."""
    scaled = size * F.lit(UNIT)
    return ((scaled - F.pmod(scaled, size + F.lit(HALF))) / (size + F.lit(HALF))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), stop: int = 3) -> DataFrame:
    """source, source_size -> also target, whole (certain copies) and part (the inclusion probability of one more)."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(w) for w in weights])
    s = sizes.withColumn("weight", F.element_at(weight, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    s = s.withColumn("most", F.col("source_size") * stop)
    by_room = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("left", F.sum("source_size").over(Window.partitionBy(F.lit(0))) - before).withColumn("share", after)
    full = F.col("most").cast("decimal(38,0)") * F.col("share") < F.col("weight").cast("decimal(38,0)") * F.col("left")
    s = s.withColumn("full", full)
    s = s.withColumn("at", F.when(~F.col("full"), F.struct((-F.row_number().over(by_room)).alias("k"), F.col("left").alias("l"), F.col("share").alias("h"))))
    s = s.withColumn("at", F.max("at").over(Window.partitionBy(F.lit(0))))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight").cast("double") * (F.col("at.l").cast("double") / F.col("at.h").cast("double")))
    s = s.withColumn("target", target)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    s = s.withColumn("ratio", ratio).withColumn("lean", F.when(F.col("ratio") > 0, F.least(F.lit(1.0), F.lit(float(stop)) / F.col("ratio") - F.lit(1.0))).otherwise(F.lit(0.0)))
    mean = F.when(F.col("source_size") > 0, F.col("weighted").cast("double") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return s.select("source", "source_size", "target", "ratio", "lean", mean.alias("mean"))


def expected(sized: DataFrame) -> DataFrame:
    """Adds whole (certain copies), part (the inclusion probability of one more) and q (odds over odds: small values are
    taken first; none without a part) to documents with their source's ratio, lean and mean."""
    copies = F.col("ratio") * (F.lit(1.0) + F.col("lean") * ((merit(F.col("size")).cast("double") - F.col("mean")) / F.lit(float(UNIT))))
    docs = sized.withColumn("copies_due", copies).withColumn("whole", F.floor("copies_due").cast("long")).withColumn("part", F.col("copies_due") - F.floor("copies_due"))
    odds = (F.col("u") / (F.lit(1.0) - F.col("u"))) / (F.col("part") / (F.lit(1.0) - F.col("part")))
    return docs.withColumn("q", F.when(F.col("part") > 0, odds))


def _bins() -> tuple[Column, Column]:
    """The bin of a rank value, and the finer one in it."""
    x = F.col("q") / (F.col("q") + 1.0)
    rough = F.when(F.col("q") < 1e300, F.floor(x * BINS)).otherwise(F.lit(BINS)).cast("int")
    return rough, F.when(F.col("q") < 1e300, F.floor(x * (BINS * BINS))).otherwise(F.lit(BINS * BINS)).cast("long")


def _cut(sums: DataFrame, by: str) -> DataFrame:
    """source, cut (the bin in which the running sum of words passes rest), before (the sum until there), rest."""
    run = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy(by))
    passed = sums.withColumn("run", run).where("run > rest and run - words <= rest").groupBy("source").agg(F.min(F.struct(by, (F.col("run") - F.col("words")).alias("before"), "rest")).alias("c"))
    return passed.select("source", F.col(f"c.{by}").alias("cut"), "c.before", "c.rest")


def cuts(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), stop: int = 3) -> DataFrame:
    """sized: doc_id, source, size, u.  A row per source: targets and the place where taking one more copy ends."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((merit(F.col("size")) * F.col("size")).cast("decimal(38,0)")).alias("weighted"))
    sources = C.materialize(targets(totals, weights, stop), "sources")
    rough, fine = _bins()
    docs = expected(join_sources(sized, sources)).withColumn("bin", rough).withColumn("fine", fine)
    drawn = F.when(F.col("part") > 0, F.col("size")).otherwise(0)
    bins = docs.groupBy("source", "bin").agg(F.sum(drawn).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.max("target").alias("target"))
    bins = bins.withColumn("rest", F.col("target") - F.sum("sure").over(Window.partitionBy("source"))).withColumn("start", F.lit(0)).where("bin is not null")
    bin_cut = C.materialize(_cut(bins, "bin"), "bins")
    near = join_sources(docs, bin_cut).where("bin = cut and size > 0")
    finer = near.groupBy("source", "fine").agg(F.sum("size").alias("words"), F.max("before").alias("start"), F.max("rest").alias("rest"))
    fine_cut = _cut(finer, "fine")
    inside = join_sources(near.drop("cut", "before", "rest"), fine_cut).where("fine = cut")
    order = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first(), "size")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", upto).where(2.0 * F.col("upto") - F.col("size") <= 2.0 * F.col("rest")).groupBy("source").agg(F.max(F.struct("q", F.coalesce("doc_id", F.lit(C.NO_ID)).alias("id"), "size")).alias("last"))
    found = join_sources(join_sources(sources, fine_cut.select("source", F.col("cut").alias("cut_fine")), "left"), last, "left")
    found = C.materialize(found.select("source", "source_size", "target", "ratio", "lean", "mean", "cut_fine", "last"), "cuts")
    C.discard(sources, bin_cut)
    return found


def join_sources(docs: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Null-safe join on source; AQE broadcasts or splits the hot source as sizes tell."""
    right = sources.withColumnRenamed("source", "s_name")
    return docs.join(right, docs["source"].eqNullSafe(right["s_name"]), how).drop("s_name")


def copies() -> Column:
    """How often a document (doc_id, size, whole, part, q) of a source with its cut is taken."""
    fine, here = _bins()[1], F.struct("q", F.coalesce(F.col("doc_id"), F.lit(C.NO_ID)).alias("id"), "size")
    at_cut = (fine == F.col("cut_fine")) & (here <= F.col("last"))
    more = (F.col("part") > 0) & (F.col("cut_fine").isNull() | (fine < F.col("cut_fine")) | F.coalesce(at_cut, F.lit(False)))
    return F.col("whole") + F.when(more, 1).otherwise(0)


def measured(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """doc_id, source, size, u and what is named in more."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), C.word_count(F.col("text").cast("string")).alias("size"), *more)
    return base.withColumn("u", uniform(seed))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), stop: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, part (probability of one more copy), copies, taken."""
    C.small_batches(C.session_of(docs))
    sized = C.materialize(measured(docs, seed), "sized")
    out = expected(join_sources(sized, cuts(sized, weights, stop))).withColumn("copies", copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "part", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), stop: int = 3, seed: str = "mix") -> DataFrame:
    """The documents themselves, each as often as it is taken; the columns of docs."""
    C.small_batches(C.session_of(docs))
    sized = C.materialize(measured(docs, seed), "sized")
    found = cuts(sized, weights, stop)
    C.discard(sized)
    # one column for what the operator needs, so that no column of docs can clash with it
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    both = expected(join_sources(measured(docs, seed, row), found))
    return both.select("row", copies().alias("n")).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


#: DuckDB's form of op5.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, sum((1000000 * size // (size + 200))::HUGEINT * size) AS weighted FROM sized GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s0),
s2 AS (SELECT *, source_size * 3 AS most, row_number() OVER (ORDER BY source_size * 3 / weight, source ASC NULLS LAST) AS k FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ())::HUGEINT - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
              sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s2),
s4 AS (SELECT *, most::HUGEINT * share < weight * room AS full_up FROM s3),
rate AS (SELECT room::DOUBLE / share::DOUBLE AS r FROM s4 WHERE NOT full_up ORDER BY k LIMIT 1),
s5 AS (SELECT source, source_size, weighted, CASE WHEN full_up THEN most::DOUBLE ELSE weight::DOUBLE * (SELECT r FROM rate) END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS ratio,
              CASE WHEN source_size > 0 THEN weighted::DOUBLE / source_size::DOUBLE ELSE 0.0 END AS mean FROM s5),
s7 AS (SELECT *, CASE WHEN ratio > 0 THEN least(1.0, 3.0 / ratio - 1.0) ELSE 0.0 END AS lean FROM s6),
d1 AS (SELECT d.doc_id, d.source, d.size, d.u, s.source_size, s.target,
              s.ratio * (1.0 + s.lean * (((1000000 * d.size // (d.size + 200))::DOUBLE - s.mean) / 1000000.0)) AS due
       FROM sized d JOIN s7 s ON d.source IS NOT DISTINCT FROM s.source),
d2 AS (SELECT *, floor(due)::BIGINT AS whole, due - floor(due) AS part FROM d1),
d3 AS (SELECT *, CASE WHEN part > 0 THEN (u / (1.0 - u)) / (part / (1.0 - part)) END AS q,
              target - sum(whole * size) OVER (PARTITION BY source) AS rest FROM d2),
d4 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM d3)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND 2.0 * upto - size <= 2.0 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d4
"""
