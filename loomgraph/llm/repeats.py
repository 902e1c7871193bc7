"""Finding every window that occurs elsewhere in a corpus, exactly and without a shuffle of all windows.

A sequence (bytes or words) is cut by content: among the ``gram``-long pieces inside a window, the one with the
smallest rolling hash is the window's trigger.  Equal windows have equal triggers at equal offsets, so it is enough
to look at windows with the same trigger.  The windows that share one trigger occurrence are consecutive; the stretch
they cover is a *phrase*.  Phrases overlap so that each window lies whole in exactly one of them, and with it the
``deep`` units from its start, if the document has so many left.

1. ``parse``: each document as its sequence of phrases: trigger, hash of the phrase, place.
2. ``entries``: the phrases whose trigger occurs at least twice; others hold no repeated window.
3. ``dictionary``: the different phrases, how often each occurs and where first.  A phrase that occurs twice repeats
   all its windows.
4. ``bodies``: the text of a phrase, from its first place, where windows have to be compared.
5. ``resolve``: phrases go to shards keyed by trigger, where the caller's resolver (suffix order, automata) compares
   their windows.  A trigger with more than ``hot`` different phrases would make a shard unbounded: its windows travel
   singly, by a 128-bit hash, through an ordinary aggregation, which marks the same windows.
6. ``remove``: the marked stretches return to the documents that hold them.

No step holds more than a document, a batch or a shard of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Windows handled at once within one document: bounds memory for very long texts.
BLOCK = 1 << 19
#: Bytes of short documents that are parsed together.
TOGETHER = 1 << 17
#: Bytes of phrases in a shard, by what is measured.
SHARD = 2_000_000
_ODD = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if "n" not in _powers or len(_powers["n"]) < n:
        size = max(n, 1 << 14)
        for name, base in (("n", _ODD), ("i", pow(_ODD, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["n"], _powers["i"]


def _sums(units: np.ndarray) -> np.ndarray:
    """Running sums of the units times the powers, from 0."""
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * _power_tables(len(units) + 1)[0][: len(units)], out=sums[1:])
    return sums


def stretches(units: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of units[first:end] for each pair."""
    sums = _sums(units)
    return C.mix64((sums[end] - sums[first]) * _power_tables(len(units) + 1)[1][first])


def rolling(units: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive units."""
    sums = _sums(units)
    return C.mix64((sums[width:] - sums[:-width]) * _power_tables(len(units) + 1)[1][: len(units) - width + 1])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """min(v[i:i+width]) for every i, in time that doesn't depend on width."""
    n = len(v)
    if width == 1:
        return v
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[:n] = v
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


def byte_units(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


def all_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return byte_units(b"".join(texts)), np.array([len(t) for t in texts], np.int64)


def all_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[data], [True]])))
    upto = np.cumsum([len(t) + 1 for t in texts])
    sizes = np.diff(np.searchsorted(edge[::2], upto), prepend=0)
    return stretches(_TABLE[data], edge[::2], edge[1::2]), sizes


@dataclass(frozen=True)
class Alphabet:
    """What a sequence consists of.  ``deep`` is at least ``window``."""

    window: int
    gram: int
    deep: int
    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # texts -> a number per unit, one text after the other, and their lengths
    cut: Callable[[bytes], object]  # text -> the sequence to slice
    join: Callable[[object], bytes]  # a slice -> its bytes


def by_bytes(window: int, gram: int, deep: int) -> Alphabet:
    return Alphabet(window, gram, deep, all_bytes, lambda text: text, lambda part: part)


def by_words(window: int, gram: int) -> Alphabet:
    return Alphabet(window, gram, window, all_words, bytes.split, b" ".join)


def _phrases(units: np.ndarray, sizes: np.ndarray, owns: np.ndarray, al: Alphabet) -> tuple[np.ndarray, ...]:
    """Of sequences one after the other, with their lengths and how many windows of each are to be dealt out."""
    if not owns.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)) + (np.zeros(len(sizes), np.int64),)
    low = np.uint64((1 << 21) - 1)
    begin = np.cumsum(sizes) - sizes
    h = rolling(units, al.gram)
    place = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), al.window - al.gram + 1) & low
    some = owns > 0
    # windows that reach into the next sequence are no one's
    edge = np.zeros(len(place) + 1, np.int8)
    edge[begin[some]] += 1
    edge[(begin + owns)[some]] -= 1
    opens = np.concatenate([[True], place[1:] != place[:-1]])
    opens[begin[some]] = True
    first = np.flatnonzero(opens & (np.cumsum(edge[:-1], dtype=np.int8) > 0))
    which = np.searchsorted(begin + sizes, first, "right")
    after = np.minimum(np.append(first[1:], len(units)), (begin + owns)[which])
    # from hashes of grams, which leaves no structure of the text in the sum
    ends = np.minimum(after - 1 + al.deep, (begin + sizes)[which]) - al.gram + 1
    keys, prints = h[place[first].astype(np.int64)].view(np.int64), stretches(h, first, ends).view(np.int64)
    return first - begin[which], (after - first).astype(np.int32), keys, prints, np.bincount(which, minlength=len(sizes))


def phrases_of(units: np.ndarray, sizes: np.ndarray, al: Alphabet) -> tuple[np.ndarray, ...]:
    """First window, number of windows, trigger and hash of each phrase, in order, and the number of phrases of each
    sequence; every window is in exactly one."""
    owns = np.maximum(sizes - al.window + 1, 0)
    if owns.sum() <= BLOCK:
        return _phrases(units, sizes, owns, al)
    found, numbers = [], []
    for begin, total in zip((np.cumsum(sizes) - sizes).tolist(), owns.tolist(), strict=True):
        numbers.append(0)
        for at in range(0, total, BLOCK):
            count = min(BLOCK, total - at)
            size = min(count + al.deep - 1, total + al.window - 1 - at)
            first, *rest, number = _phrases(units[begin + at : begin + at + size], np.array([size]), np.array([count]), al)
            found.append((first + at, *rest))
            numbers[-1] += int(number[0])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) + (np.array(numbers, np.int64),)


def _together(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, short ones several at a time."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > TOGETHER:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    yield some


def columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


Fields = list[tuple[str, pa.DataType, str]]


def _rows(rows: list[tuple], fields: Fields) -> list[pa.Array]:
    return [pa.array(c, t) for c, (_, t, _) in zip(zip(*rows, strict=True), fields, strict=True)]


def parse(docs: DataFrame, al: Alphabet, summary: Callable[[bytes], tuple], fields: Fields) -> DataFrame:
    """k1, k2, doc_id, the document's phrases (starts, counts, keys, prints) and the summary that holds if nothing goes."""
    kinds = (("starts", pa.int64()), ("counts", pa.int32()), ("keys", pa.int64()), ("prints", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            *found, numbers = (np.concatenate(x) for x in zip(*(phrases_of(*al.units(some), al) for some in _together(texts)), strict=True))
            held = [batch.column(batch.schema.get_field_index(n)) for n in ("k1", "k2", "doc_id")]
            offsets = pa.array(np.cumsum([0, *numbers.tolist()]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, (_, t) in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*held, *lists, *_rows([summary(t) for t in texts], fields)], names=["k1", "k2", "doc_id", *(n for n, _ in kinds), *(n for n, _, _ in fields)])
        C.release()

    sql = ["k1 long", "k2 int", "doc_id long", "starts array<long>", "counts array<int>", "keys array<long>", "prints array<long>"]
    return docs.mapInArrow(run, ", ".join([*sql, *(f"{n} {s}" for n, _, s in fields)]))


def entries(parsed: DataFrame) -> DataFrame:
    """k1, k2, start, n, key, p: each phrase whose trigger occurs at least twice in the corpus.

    The repeated triggers are written first: as a table of its own, that side lets AQE split a trigger that is everywhere.
    """
    keys = parsed.select(F.explode("keys").alias("key"))
    again = C.materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key"), "again")
    each = parsed.select("k1", "k2", F.inline(F.arrays_zip("starts", "counts", "keys", "prints"))).toDF("k1", "k2", "start", "n", "key", "p")
    held = C.materialize(each.join(again, "key").select("k1", "k2", "start", "n", "key", "p"), "entries")
    C.discard(again)
    return held


def dictionary(held: DataFrame) -> DataFrame:
    """key, p, n, n_seen, kinds (different phrases of the trigger) and the first place (e1, e2, e3) of each different phrase."""
    first = F.min(F.struct(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("start").alias("e3"))).alias("e")
    phrases = C.materialize(held.groupBy("key", "p").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("n_seen"), first).select("key", "p", "n", "n_seen", "e.*"), "phrases")
    kinds = phrases.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"))
    known = C.materialize(phrases.join(kinds, "key"), "dictionary")
    C.discard(phrases)
    return known


def bodies(docs: DataFrame, wanted: DataFrame, al: Alphabet) -> DataFrame:
    """wanted, a part of the dictionary, with each phrase's text."""
    names = ["key", "p", "n", "n_seen", "kinds", "e3"]
    per = wanted.select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), F.struct(*names).alias("x")).groupBy("k1", "k2").agg(F.collect_list("x").alias("xs"))
    # rows that repeat a document give its texts again, which changes nothing
    texts = docs.select("k1", "k2", "text").join(per, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_text(rows: pa.RecordBatch, parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(parts, pa.binary())], names=[*rows.schema.names, "phrase"])

        for batch in batches:
            k1, k2, text, xs = (batch.column(batch.schema.get_field_index(n)) for n in ("k1", "k2", "text", "xs"))
            counts = np.diff(xs.offsets.to_numpy())
            rows = pa.RecordBatch.from_arrays([*xs.flatten().flatten(), *(k.take(pa.array(np.repeat(np.arange(len(counts)), counts))) for k in (k1, k2))], names=[*names, "e1", "e2"])
            first = rows.column("e3").to_numpy()
            ends = first + rows.column("n").to_numpy() - 1 + al.deep
            spans = zip(first.tolist(), ends.tolist(), strict=True)
            parts, size, done = [], 0, 0
            for t, count in zip(text.to_pylist(), counts.tolist(), strict=True):
                seq = al.cut(t)
                for a, b in islice(spans, count):
                    parts.append(al.join(seq[a:b]))
                    size += len(parts[-1])
                    if size > 4_000_000:
                        yield with_text(rows.slice(done, len(parts)), parts)
                        parts, size, done = [], 0, done + len(parts)
            if parts:
                yield with_text(rows.slice(done), parts)
        C.release()

    return texts.mapInArrow(run, "key long, p long, n int, n_seen long, kinds long, e3 long, e1 long, e2 int, phrase binary")


def runs_of(flags: np.ndarray) -> list[int]:
    """[from, to, from, to, ...] of the stretches of true flags, both ends included."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


#: A phrase, how many windows are its own, how often it occurs, its first place (k1, k2, start).
Member = tuple[bytes, int, int, tuple[int, int, int]]
#: From triggers with their phrases: for each phrase the runs (as of runs_of) of its own windows under each name of marks.
Resolver = Callable[[list[tuple[int, list[Member]]]], list[list[list[list[int]]]]]


def resolve(texts: DataFrame, al: Alphabet, resolver: Resolver, names: list[str], singly: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """key, p and, under each name, the windows of the phrase that the resolver marks.

    singly takes the windows of hot triggers (name, h1, h2, key, p, e1, e2, e3, off, n_seen) and returns those to mark.
    """
    out = pa.schema([("key", pa.int64()), ("p", pa.int64()), *((n, pa.list_(pa.int32())) for n in names)])
    sql = ", ".join(["key long", "p long", *(f"{n} array<int>" for n in names)])
    cold = texts.where(F.col("kinds") <= most)
    # a shard: whole triggers, of at most ``most`` phrases each
    shards = C.shards_for(cold.agg(F.sum(F.length("phrase") + 64)).first()[0], SHARD, 8)
    cold = cold.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))

    def shard(table: pa.Table) -> pa.Table:
        groups: dict[int, dict[int, Member]] = {}
        for batch in table.to_batches():
            for key, p, n, n_seen, phrase, *place in columns(batch, "key", "p", "n", "n_seen", "phrase", "e1", "e2", "e3"):
                groups.setdefault(key, {})[p] = (phrase, n, n_seen, tuple(place))
        order = [(key, sorted(g.items())) for key, g in sorted(groups.items())]
        found = resolver([(key, [v for _, v in g]) for key, g in order])
        rows = [(key, p, *runs) for (key, g), each in zip(order, found, strict=True) for (p, _), runs in zip(g, each, strict=True) if any(runs)]
        del groups, order, found
        C.release()
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], out.types[i]) for i in range(len(out))], schema=out)

    marked = cold.select("shard", "key", "p", "n", "n_seen", "phrase", "e1", "e2", "e3").groupBy("shard").applyInArrow(shard, sql)

    # the rest, window by window
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, p, n, n_seen, phrase, e1, e2, e3 in columns(batch, "key", "p", "n", "n_seen", "phrase", "e1", "e2", "e3"):
                units = al.units([phrase])[0]
                for width in sorted({al.window, al.deep}):
                    if len(units) < width:
                        continue
                    h1, h2 = (rolling(u, width)[:n] for u in (units, C.mix64(units + np.uint64(0x1234567))))
                    off = np.arange(len(h1), dtype=np.int32)
                    same = [pa.array(np.full(len(off), v, np.int64)) for v in (width, key, p, e1, e2, n_seen)]
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *same, pa.array(e3 + off.astype(np.int64)), pa.array(off)], names=["h1", "h2", "width", "key", "p", "e1", "e2", "n_seen", "e3", "off"])

    hot = texts.where(F.col("kinds") > most).mapInArrow(windows, "h1 long, h2 long, width long, key long, p long, e1 long, e2 long, n_seen long, e3 long, off int")

    def merged(table: pa.Table) -> pa.Table:
        which, off = table.column("name").to_numpy(zero_copy_only=False), table.column("off").to_numpy()
        found = []
        for name in names:
            flags = np.zeros(int(off.max()) + 1, bool)
            flags[off[which == name]] = True
            found.append(pa.array([runs_of(flags)], out.types[2]))
        return pa.Table.from_arrays([table.column("key")[:1], table.column("p")[:1], *found], schema=out)

    rest = singly(hot).select("key", "p", "name", "off").distinct().groupBy("key", "p").applyInArrow(merged, sql)
    return C.materialize(marked.unionByName(rest), "marks")


def covered(n: int, width: int, spans: np.ndarray) -> np.ndarray:
    """Whether each of n units lies in a string of that width that starts in one of the spans (from, to, from, to, ...)."""
    edge = np.zeros(n + 1, np.int32)
    first, last = spans[::2], np.minimum(spans[1::2], n - width)
    fits = first <= last
    np.add.at(edge, first[fits], 1)
    np.add.at(edge, last[fits] + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _slices(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


@dataclass(frozen=True)
class Plan:
    """What an operator adds to the chain."""

    al: Alphabet
    resolver: Resolver
    singly: Callable[[DataFrame], DataFrame]
    hot: int  # more different phrases than this behind one trigger, and its windows are compared singly
    names: list[str]  # of the marks
    wanted: str  # the phrases that go to the resolver
    spans: Callable[[str], Column]  # from a phrase, its marks and an occurrence: the spans to mark there, under a name
    widths: dict[str, int]  # of what a mark covers, by the names that documents need
    summary: Callable[[bytes], tuple]  # of a document in which nothing is marked
    finish: Callable  # (sequence, flags of units under each of these names) -> the summary otherwise
    fields: Fields


def remove(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id and the summary's fields."""
    al, names, fields = plan.al, list(plan.widths), plan.fields
    C.small_batches(C.session_of(docs))
    docs = C.id_and_text(docs).select("doc_id", "text", *C.row_keys())
    parsed = C.materialize(parse(docs, al, plan.summary, fields), "parsed")
    held = entries(parsed)
    plain = C.materialize(parsed.drop("starts", "counts", "keys", "prints"), "plain")
    C.discard(parsed)
    known = dictionary(held)
    texts = C.materialize(bodies(docs, known.where(plan.wanted), al), "bodies")
    marks = resolve(texts, al, plan.resolver, plan.names, plan.singly, plan.hot)
    C.discard(texts)
    # a table of its own lets AQE split a phrase that is everywhere
    told = C.materialize(known.where("n_seen >= 2 or kinds >= 2").join(marks, ["key", "p"], "left"), "told")
    C.discard(known, marks)
    # rows that repeat a document give its places twice, which marks them no differently
    none = F.array().cast("array<int>")
    places = held.select("k1", "k2", "start", "key", "p").join(told, ["key", "p"])
    places = places.select("k1", "k2", *[F.transform(F.coalesce(plan.spans(n), none), lambda x: x + F.col("start")).alias(n) for n in names]).where(" or ".join(f"size({n}) > 0" for n in names))
    marked = C.materialize(places.groupBy("k1", "k2").agg(*[F.flatten(F.collect_list(n)).alias(n) for n in names]), "marked")
    C.discard(held, told)
    schema = [("k1", pa.int64()), ("k2", pa.int32()), *((f"new_{n}", t) for n, t, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = zip(*(_slices(batch.column(batch.schema.get_field_index(n))) for n in names), strict=True)
            for (k1, k2, text), each in zip(columns(batch, "k1", "k2", "text"), spans, strict=True):
                seq = al.cut(text)
                out.append((k1, k2, *plan.finish(seq, *(covered(len(seq), w, s) for w, s in zip(plan.widths.values(), each, strict=True)))))
            if out:
                yield pa.RecordBatch.from_arrays(_rows(out, [("k1", pa.int64(), ""), ("k2", pa.int32(), ""), *fields]), schema=pa.schema(schema))
        C.release()

    sql = ", ".join(["k1 long", "k2 int", *(f"new_{n} {s}" for n, _, s in fields)])
    changed = docs.select("k1", "k2", "text").join(marked, ["k1", "k2"]).mapInArrow(run, sql).dropDuplicates(["k1", "k2"])
    kept = plain.join(changed, ["k1", "k2"], "left")
    return kept.select("doc_id", *(F.coalesce(f"new_{n}", n).alias(n) for n, _, _ in fields))
