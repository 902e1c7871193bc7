"""Benchmark decontamination with DataFrame operations only.

A document is held against the benchmark in windows as long as its items:

1. windows: where a five-word shingle of the document is one of the benchmark's, windows of the lengths and alignments
   at which items have it are laid, whichever items these are.  A window that shares no shingle with an item at its
   place has no part of it in order, so no window that could be the best of a pair is left out.
2. SimHash: each window and item gets a 64-bit fingerprint of its weighted shingles.
3. multi-index Hamming blocks: fingerprints are cut into ``radius + 1`` blocks; two within ``radius`` bits agree in at
   least one of them, so an equi-join of windows and items on (length, block, bits) finds all fingerprints within the
   radius.  This join alone makes the candidate pairs.
4. exact check: weighted (multiset) Jaccard similarity of the shingles, at least ``similarity``.

A window of similarity 0.8 is expected about 10 bits away from its item, give or take 3; the radius of 23 leaves none out
in practice, at the price of blocks of two and three bits, which part windows from other items of the length weakly.

Words are runs of letters and digits in lower case, so that punctuation and line breaks don't hide a passage.
The shingles of the benchmark are broadcast only up to ``BROADCAST_ROWS``; a larger benchmark is joined by shuffle.

Defined results: null text has no words; documents or items of fewer than five words have no shingle and match nothing;
items that repeat an item_id are held separately and the best match counts; repeated document rows give one row per text
and item; an empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
BROADCAST_ROWS = 500_000


def shingle_hashes(text: Column) -> Column:
    """A hash for each five consecutive words; empty for fewer words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    return _grams(F.transform(words, lambda w: F.xxhash64(w)))


def _grams(h: Column) -> Column:
    # the array of words is bound once as the variable of an outer lambda
    each = F.transform(F.array(h), lambda a: F.when(F.size(a) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(a) - SHINGLE), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(SHINGLE)]))).otherwise(F.array().cast("array<bigint>")))
    return F.get(each, F.lit(0))


def fingerprint(shingles: Column) -> Column:
    """Bit b is 1 if it is set in more than half of the shingles, repeats included."""
    bits = lambda b: F.aggregate(shingles, F.lit(0), lambda n, x: n + F.getbit(x, b).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.when(bits(b) * 2 > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))))


def blocks(fp: Column, radius: int) -> Column:
    """radius + 1 pieces of the fingerprint with their numbers."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    piece = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(k).alias("block"), piece(a, b).alias("bits")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard: sum of least counts over sum of greatest counts."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def find(docs: DataFrame, benchmark: DataFrame, similarity_least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start (word of the window), n_words of the item, hamming, similarity: the best window of each pair."""
    found = matches(docs, benchmark, similarity_least, radius)
    return found.select(F.when(F.col("k1") != C.NO_ID, F.col("k1")).alias("doc_id"), "item_id", "start", "n_words", "hamming", "similarity")


def matches(docs: DataFrame, benchmark: DataFrame, similarity_least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The same with the row's keys k1 and k2 (id and text) in place of doc_id."""
    if not 0 <= radius <= 31:
        raise ValueError("radius + 1 blocks of at least two bits are needed")
    C.small_batches(C.session_of(docs))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), shingle_hashes(F.col("text")).alias("item")).where(F.size("item") > 0).distinct()
    items = items.select("item_id", "item", F.xxhash64("item").alias("item_key"), fingerprint(F.col("item")).alias("item_fp"))
    items = C.materialize(items, "items")
    grams = items.select(F.size("item").alias("n"), F.posexplode("item").alias("at", "gram"))
    # where a shingle may stand in an item, and in items how long: a bounded list, and one row a shingle
    places = grams.groupBy("gram").agg(F.collect_set(F.struct("at", "n")).alias("places"))
    few = items.agg(F.sum(F.size("item"))).first()[0] or 0
    if few <= BROADCAST_ROWS:
        places = F.broadcast(places)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = base.select("text", *C.row_keys())
    hits = keyed.select("k1", "k2", F.posexplode(shingle_hashes(F.col("text"))).alias("pos", "gram")).join(places, "gram")
    laid = hits.select("k1", "k2", "pos", F.inline("places")).select("k1", "k2", "n", (F.col("pos") - F.col("at")).alias("start")).distinct()
    laid = C.materialize(laid, "laid")
    found = laid.groupBy("k1", "k2").agg(F.collect_list(F.struct("n", "start")).alias("laid"))
    # rows that repeat a document give its windows again, which the distinct below takes out
    full = keyed.join(found, ["k1", "k2"]).select("k1", "k2", "laid", shingle_hashes(F.col("text")).alias("doc"))
    windows = full.select("k1", "k2", "doc", F.inline("laid"))
    low, high = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("start") + F.col("n"), F.size("doc"))
    windows = windows.select("k1", "k2", "n", "start", F.slice("doc", low + 1, F.greatest(high - low, F.lit(0))).alias("win"))
    windows = C.materialize(windows.withColumn("fp", fingerprint(F.col("win"))), "windows")
    C.discard(laid)
    left = windows.select("k1", "k2", "n", "start", "fp", F.inline(blocks(F.col("fp"), radius)))
    right = items.select("item_id", "item_key", F.size("item").alias("n"), "item_fp", F.inline(blocks(F.col("item_fp"), radius)))
    near = left.join(right, ["n", "block", "bits"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    near = near.where(F.col("hamming") <= radius).select("k1", "k2", "n", "start", "item_id", "item_key", "hamming").distinct()
    checked = near.join(windows.select("k1", "k2", "n", "start", "win"), ["k1", "k2", "n", "start"]).drop("n").join(items.select("item_id", "item_key", "item"), ["item_id", "item_key"])
    checked = checked.withColumn("similarity", similarity(F.col("win"), F.col("item"))).where(F.col("similarity") >= similarity_least)
    best = checked.groupBy("k1", "k2", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (F.size("item") + SHINGLE - 1).alias("n"), "hamming")).alias("b"))
    return best.select("k1", "k2", "item_id", (-F.col("b.s")).alias("start"), F.col("b.n").alias("n_words"), F.col("b.hamming").alias("hamming"), F.col("b.similarity").alias("similarity"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage, with the columns of docs."""
    bad = matches(docs, benchmark).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    same_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(C.NO_ID)) == bad["_k1"]
    return docs.join(bad, same_id & (F.hash(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["_k2"]), "left_anti")
