"""SimHash near-dedup: fingerprints of word shingles, linked by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common neighbour within r bits of each.  So every different
fingerprint emits all variants within half the radius, the variants are shuffled, and fingerprints that meet are
verified.  At an even radius those meeting at one variant are within the radius of each other, so each is tied to the
least of them: a star, not all pairs, links the same documents.  Components come from min-label propagation with
pointer jumping over the different fingerprints; copies of a text collapse into one fingerprint beforehand.

``dedup`` links fingerprints alone.  ``near_copies`` finds texts whose sets of five-word shingles have Jaccard similarity
0.8 or more.  One 64-bit fingerprint can't: such texts differ in 5 to 10 of its bits, and a ball that wide has millions of
members.  So the same balls are laid round ``TABLES`` short fingerprints of ``BITS`` bits, made from two-word shingles,
which an edit disturbs less; texts that meet in any table are held against each other over all tables, then by their
exact sets.  What that misses by chance is found exactly among texts of different components (``missed_pairs``): sets of
similarity 0.8 share some of their first fifth in any common order, so shingles of those prefixes, rare ones first, are
joined, and what shares enough of them is verified.

Defined results: null text and text without words have fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of the whole sequence; a null doc_id sorts before all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repeats import columns

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SLICE = 1 << 14
#: Short fingerprints of near_copies: their number, bits, words of a shingle; share of all their bits that may differ.
TABLES, BITS, PRINT_WORDS, FAR = 6, 32, 2, 0.3
#: Least similarity of near copies as a fraction of whole numbers, so that the test has no rounding.
LEAST = (4, 5)
#: Similar sets share so many shingles of their prefixes; more make prefixes longer and candidates fewer.
SHARED = 3
#: Frequent shingles that order the prefixes: their number, and the shingles that are counted at once.
FREQUENT, CHUNK = 500_000, 1 << 21


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):  # bounds memory for long texts
        bits = np.unpackbits(hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def shingles(words: list[bytes], words_each: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - words_each].tolist()]
    stops = (ends[words_each - 1 :] - 1).tolist()
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: bytes, words_each: int = 3) -> int:
    return majority(shingles(text.translate(_LOWER).split(), words_each))


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words_each) for (t,) in columns(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """All 64-bit masks with at most ``radius`` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def spread(table: DataFrame, by: str, rows: int = 20_000) -> DataFrame:
    """A materialized table dealt out so that each task explodes about as many rows, whatever files it lies in."""
    return table.repartition(C.shards_for(table.count(), rows, 8), by)


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a < b: pairs of different fingerprints, enough to link all that are within the radius through others."""
    if radius % 2:
        raise ValueError("the radius must be even: each side emits variants within half of it")
    variants = spread(fps, "fp").select("fp", F.explode(F.array(*[F.lit(m) for m in ball(radius // 2)])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    # different fingerprints within r bits of one variant: at most as many as the ball has members
    met = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the least label among the nodes reachable.  nodes: node, label (different for each node).

    Each round takes the least label of the neighbours and then the label's own label, so long chains shorten fast.
    """
    both = C.materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    linked = both.select(F.col("a").alias("node")).distinct()
    labels = C.materialize(nodes.join(linked, "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # the label is the least label of some node: jump to what that node has by now
        owner = step.join(nodes.select("node", F.col("label").alias("name")), "node").select(F.col("name").alias("label"), F.col("label").alias("jump"))
        step = step.join(owner, "label", "left").select("node", "was", F.least("label", F.coalesce("jump", "label")).alias("label"))
        step = C.materialize(step, "labels")
        C.discard(labels)
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            C.discard(both)
            return labels.select("node", F.col("label").alias("root"))


def dedup(docs: DataFrame, radius: int = 2, words_each: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable), fp."""
    C.small_batches(C.session_of(docs))
    prints = C.materialize(fingerprints(C.id_and_text(docs), words_each), "prints")
    kinds = C.materialize(prints.groupBy(F.col("fp").alias("node")).agg(F.min(F.coalesce("doc_id", F.lit(C.NO_ID))).alias("label")), "kinds")
    # copies of a doc_id may carry several fingerprints: labels must differ, so ties take the fingerprint along
    label = F.struct(F.col("label").alias("id"), F.col("node").alias("fp"))
    kinds = kinds.select("node", label.alias("label"))
    found = components(kinds, links(kinds.select(F.col("node").alias("fp")), radius))
    roots = kinds.join(found, "node", "left").select(F.col("node").alias("fp"), F.coalesce("root.id", "label.id").alias("component_id"))
    out = prints.join(roots, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("component_id") != C.NO_ID, F.col("component_id")).alias("component_id"), "fp")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def row_name() -> list[Column]:
    """What names a row: its id (null as NO_ID) and a hash of its text (null as empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NO_ID)), F.xxhash64(text)]


def _shingle_set(text: bytes, words_each: int) -> np.ndarray:
    return np.unique(shingles(text.translate(_LOWER).split(), words_each)).view(np.int64)


def _prints(words: list[bytes], tables: int, bits: int, print_words: int) -> np.ndarray:
    """Independent fingerprints of ``bits`` bits each."""
    h, each = shingles(words, print_words), 64 // bits
    whole = [majority(C.mix64(h + np.uint64(k + 1))) for k in range(-(-tables // each))]
    return np.array([w >> bits * i & (1 << bits) - 1 for w in whole for i in range(each)][:tables], np.uint64).view(np.int64)


def frequent(rows: DataFrame, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) and counts of the most frequent ones; all text is read, in chunks that drop what they hold less than
    three times.  They only set the order of prefixes: any order finds the same pairs, rare shingles first make fewer candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u[c > 2]), pa.array(c[c > 2].astype(np.int64))], names=["s", "c"])

        for batch in batches:
            for (text,) in columns(batch, "text"):
                held.append(_shingle_set(text, words_each))
                size += len(held[-1])
                if size >= CHUNK:
                    yield counted()
                    held, size = [], 0
        yield counted()
        C.release()

    top = rows.select("text").mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(FREQUENT).toPandas()
    top = top.sort_values("s")
    return top["s"].to_numpy(np.int64), top["c"].to_numpy(np.int64)


def _prefix(s: np.ndarray, names: np.ndarray, counts: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set by (count, shingle): any similar set shares SHARED of them, or all it must share if fewer."""
    at = np.minimum(np.searchsorted(names, s), max(len(names) - 1, 0))
    count = np.where(names[at] == s, counts[at], 0) if len(names) else np.zeros(len(s), np.int64)
    return s[np.lexsort((s, count))][: len(s) - -(-len(s) * least[0] // least[1]) + SHARED]


def _verified(rows: DataFrame, kinds: DataFrame, pairs: DataFrame, words_each: int, least: tuple[int, int]) -> DataFrame:
    """Those of the materialized pairs a, b of keys whose sets of shingles are similar."""
    up, down = least

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([_shingle_set(t, words_each) for (t,) in columns(batch, "text")])], names=["key", "set"])
        C.release()

    wanted = kinds.join(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "key").select("key", "label.id", "label.th")
    # rows that repeat id and text make one
    named = C.materialize(rows.join(wanted, ["id", "th"]).select("key", "text").mapInArrow(members, "key long, set array<long>").dropDuplicates(["key"]), "members")
    both = pairs.join(named.select(F.col("key").alias("a"), F.col("set").alias("s")), "a").join(named.select(F.col("key").alias("b"), F.col("set").alias("t")), "b")
    found = C.materialize(both.where(F.size(F.array_intersect("s", "t")) * F.lit(up + down) >= (F.size("s") + F.size("t")) * F.lit(up)).select("a", "b"), "edges")
    C.discard(named)
    return found


def near_pairs(rows: DataFrame, words_each: int, least: tuple[int, int], tables: int = TABLES, bits: int = BITS, print_words: int = PRINT_WORDS) -> tuple[DataFrame, DataFrame]:
    """rows: id, th, text.  The kinds (key of a different set of shingles; label, the least row that has it; prefix) and the
    similar pairs a < b of keys met."""
    if bits not in (8, 16, 32, 64):
        raise ValueError("bits must divide 64")
    order = rows.sparkSession.sparkContext.broadcast(frequent(rows, words_each))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, prefixes = [], [], [], []
            for (text,) in columns(batch, "text"):
                words = text.translate(_LOWER).split()
                s = np.unique(shingles(words, words_each))
                keys.append(xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63))
                sizes.append(len(s))
                prints.append(_prints(words, tables, bits, print_words))
                prefixes.append(_prefix(s.view(np.int64), *order.value, least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), _lists(prints), _lists(prefixes)], names=["id", "th", "key", "n", "prints", "prefix"])
        C.release()

    made = rows.select("id", "th", "text").mapInArrow(sets, "id long, th long, key long, n int, prints array<long>, prefix array<long>")
    kinds = C.materialize(made.groupBy("key").agg(F.min(F.struct("id", "th", "key", "n", "prints", "prefix")).alias("x")).select("key", F.struct("x.id", "x.th", "x.key").alias("label"), "x.n", "x.prints", "x.prefix"), "kinds")

    at = kinds.select("key", F.posexplode("prints").alias("t", "print"))
    # texts of one short fingerprint are tied to the least of them, which alone emits its variants
    spots = C.materialize(at.groupBy("t", "print").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")), "spots")
    same = at.join(spots.where("n > 1"), ["t", "print"]).where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    masks = [0, *(1 << b if b < 63 else -(1 << 63) for b in range(bits))]
    variants = spread(spots.select("t", "print", "rep"), "print").select("t", "print", "rep", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select("t", "rep", F.col("print").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.groupBy("t", "variant").agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1)
    stars = met.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    pairs = C.materialize(stars.union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    C.discard(spots)

    # over all tables, and by size: what is left is verified by the sets
    up, down = least
    side = lambda x: kinds.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("prints").alias(f"p{x}"))
    apart = sum((F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(tables)), F.lit(0))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where((apart <= int(FAR * tables * bits)) & (F.least("na", "nb") * down >= F.greatest("na", "nb") * up))
    close = C.materialize(close.select("a", "b"), "close")
    found = _verified(rows, kinds, close, words_each, least)
    C.discard(pairs, close)
    return kinds, found


def missed_pairs(rows: DataFrame, kinds: DataFrame, parts: DataFrame, words_each: int, least: tuple[int, int]) -> DataFrame:
    """All similar pairs a, b of keys in different parts.  parts: key, part (materialized), one row for each kind.

    Only shingles that the prefixes of two parts hold are joined, so that a large group of near copies that is one part
    already meets none but its outsiders.  How far into a prefix a shared shingle may stand depends on both sizes: of what
    two sets must share, all but the first SHARED - 1 come after the SHARED-th.  So a place bounds the size of its partner.
    Links to one set for each shingle join most parts before the rest is compared.
    """
    up, down = least
    held = kinds.select("key", F.col("n").cast("long").alias("n"), "prefix").join(parts, "key")
    posts = spread(held, "key", 2000).select("key", "n", "part", F.posexplode("prefix").alias("i", "s"))
    shared = C.materialize(posts.groupBy("s").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("s"), "shared")
    # the most that a partner may have, so that what both must share still fits behind this place
    most = F.expr(f"(n - i + {SHARED - 1}) * {up + down} div {up} - n")
    posts = C.materialize(posts.join(shared, "s").withColumn("most", most), "posts")
    apart = (F.col("parta") != F.col("partb")) & (F.col("mosta") >= F.col("nb")) & (F.col("mostb") >= F.col("na")) & (F.least("na", "nb") * down >= F.greatest("na", "nb") * up)

    # first one link a place, to the set that has the shingle earliest: what differs least from its kin.  It joins most parts
    lead = posts.groupBy("s").agg(F.min(F.struct((F.col("i") / F.col("n")).alias("at"), "key", "n", "part", "most")).alias("x"))
    lead = C.materialize(lead.select("s", *[F.col(f"x.{c}").alias(c + "a") for c in ("key", "n", "part", "most")]), "lead")
    side = lambda x: [F.col(c).alias(c + x) for c in ("key", "n", "part", "most")]
    tied = C.materialize(lead.join(posts.select("s", *side("b")), "s").where(apart).select(F.least("keya", "keyb").alias("a"), F.greatest("keya", "keyb").alias("b")).distinct(), "tied")
    found = _verified(rows, kinds, tied, words_each, least)
    now = C.materialize(components(parts.select(F.col("part").alias("node"), F.col("part").alias("label")).distinct(), between(found, parts)).withColumnRenamed("node", "part"), "now")

    # then all of what is still in different parts; the part that holds a shingle most often needs no pairs within itself
    moved = C.materialize(posts.drop("i").join(now, "part", "left").withColumn("part", F.coalesce("root", "part")).drop("root"), "moved")
    major = moved.groupBy("s", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.max_by("part", F.struct("c", "part")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    major = C.materialize(major, "major")
    minor = C.materialize(moved.join(major, "s").where("part <> major"), "minor")
    met = minor.select("s", "major", *side("a")).join(moved.select("s", *side("b")), "s").where(((F.col("partb") == F.col("major")) | (F.col("keya") < F.col("keyb"))) & apart)
    # sets that need not share so many share what they must
    must = F.expr(f"((na + nb) * {up} + {up + down - 1}) div {up + down}")
    pairs = met.groupBy(F.least("keya", "keyb").alias("a"), F.greatest("keya", "keyb").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first(must).alias("must")).where((F.col("k") >= SHARED) | (F.col("k") >= F.col("must"))).select("a", "b")
    pairs = C.materialize(pairs, "missed")
    C.discard(shared, posts, lead, tied, now, moved, major, minor)
    found = found.union(_verified(rows, kinds, pairs, words_each, least))
    C.discard(pairs)
    return found


def between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs a, b of keys as pairs of their parts."""
    a, b = (parts.withColumnsRenamed({"key": x, "part": "p" + x}) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()


def near_copies(docs: DataFrame, words_each: int = 5, least: tuple[int, int] = LEAST, tables: int = TABLES, bits: int = BITS, print_words: int = PRINT_WORDS, exact: bool | None = None) -> DataFrame:
    """key, label, root: for each different set of shingles the least row that has it, and the least of its component.

    All similar pairs are found; with ``exact`` false, or fingerprints of the caller's own and ``exact`` not asked for, those
    the fingerprints meet.

    label and root are structs of id, th (row_name) and key.
    """
    C.small_batches(C.session_of(docs))
    row_id, th = row_name()
    rows = docs.select(row_id.alias("id"), th.alias("th"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kinds, edges = near_pairs(rows, words_each, least, tables, bits, print_words)
    roots = components(kinds.select(F.col("key").alias("node"), "label"), edges).select(F.col("node").alias("key"), "root")
    first = kinds.select("key", "label").join(roots, "key", "left").select("key", "label", F.coalesce("root", "label").alias("root"))
    if not (exact if exact is not None else (tables, bits, print_words) == (TABLES, BITS, PRINT_WORDS)):
        return first
    first = C.materialize(first, "first")
    C.discard(edges)
    parts = first.select("key", F.col("root.key").alias("part"))
    missed = missed_pairs(rows, kinds, parts, words_each, least)
    links = between(missed, parts)
    leads = first.where("label = root").select(F.col("key").alias("node"), "label")
    joined = components(leads, links).select(F.col("node").alias("part"), F.col("root").alias("top"))
    C.discard(missed)
    return first.withColumn("part", F.col("root.key")).join(joined, "part", "left").select("key", "label", F.coalesce("top", "root").alias("root"))


def without_near_copies(docs: DataFrame, **setting) -> DataFrame:
    """Of each component of near copies one row, that of the least doc_id (null first) and then text hash; docs' columns."""
    leads = near_copies(docs, **{"exact": True} | setting).where("label = root").select("label.id", "label.th")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    row_id, th = row_name()
    return docs.select(row, row_id.alias("id"), th.alias("th")).join(leads, ["id", "th"]).dropDuplicates(["id", "th"]).select("row.*")
