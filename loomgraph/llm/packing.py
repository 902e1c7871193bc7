"""Token-id output: best-fit-decreasing packing of whole documents into rows of fixed length.

Every text becomes token ids with an end mark; a document longer than a row is split without loss.  Pieces are dealt to
shards by a hash of document and piece; the number of shards follows from the number of tokens, so that each is of
bounded size and the rows depend on nothing but the documents.  Within a shard, pieces go by falling length into the row
with the least room that still holds them.  A segment tree over room sizes answers that search.  A row of the result is a
row of the id matrix (little-endian, padded), the cumulative lengths of its segments, and positions that start again
at 0 with each segment.

Defined results: null text counts as empty and gives just the end mark; a text of any length has the ids of the whole
text (long ones are encoded in parts, cut only where the pre-tokenizer cuts in any context); documents of equal length
lie in the order of a hash; repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .repeats import columns

ROW = 2048
END = 50256
#: Tokens in a shard.
SHARD = 3_000_000
#: Characters encoded at once, or more where no safe cut follows.
PART = 1 << 20
#: Before a blank between one of these and a letter a new piece begins, whatever stands around them.
SAFE = re.compile(r"(?<=[A-Za-z0-9,.;:!?])(?= [A-Za-z])")

_encoders: dict[str, object] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """A byte-level BPE from a file of ranks; built once in each worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


class Rooms:
    """How many open rows have each amount of room; a segment tree finds the least room that suffices."""

    def __init__(self, row: int) -> None:
        self.size = 1 << row.bit_length()
        self.some = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at and not self.some[at]:
            self.some[at] = True
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the fullest row with at least that room; it leaves the tree."""
        at = need + self.size
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[at] = False
            at >>= 1
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = False
                at >>= 1
        return room, row


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Which items lie in each row; lengths in falling order."""
    rooms, rows = Rooms(row), []
    for i, need in enumerate(lengths):
        got = rooms.take(need)
        if got is None:
            rows.append([i])
            room, at = row - need, len(rows) - 1
        else:
            room, at = got[0] - need, got[1]
            rows[at].append(i)
        if room:
            rooms.add(room, at)
    return rows


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` characters whose ids, one after the other, are those of the whole text."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def tokens(docs: DataFrame, row: int, path: str, end: int) -> DataFrame:
    """doc_id, piece, h, n, ids (little-endian uint16)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("h", pa.int64()), ("n", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            out = []
            for doc_id, text, h in columns(b, "doc_id", "text", "h"):
                ids = np.concatenate([*(np.array(enc.encode_ordinary(p), "<u2") for p in parts(text)), np.array([end], "<u2")])
                for k, at in enumerate(range(0, len(ids), row)):
                    piece = ids[at : at + row]
                    out.append((doc_id, k, h + k & 0x7FFFFFFFFFFFFFFF, len(piece), piece.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        C.release()

    return docs.mapInArrow(run, "doc_id long, piece int, h long, n int, ids binary")


def pack(docs: DataFrame, row: int = ROW, path: str | None = None, shards: int | None = None, end: int = END, pad: int | None = None) -> DataFrame:
    """shard, row, n_tokens, input_ids, position_ids (uint16 matrices' rows), cu_seqlens, doc_ids, pieces.

    end marks the end of a document, pad (the end mark if not given) fills rows; path names the tokenizer's file.
    """
    if not 2 <= row <= 65535:
        raise ValueError("positions are written as uint16")
    if not (0 <= end <= 65535 and 0 <= (end if pad is None else pad) <= 65535):
        raise ValueError("ids are written as uint16")
    pad = end if pad is None else pad
    C.small_batches(C.session_of(docs))
    made = C.materialize(tokens(docs, row, path or tokenizer_path(), end), "tokens")
    shards = shards or C.shards_for(made.agg(F.sum("n")).first()[0], SHARD, 8)
    made = made.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    schema = pa.schema([("shard", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])

    def shard(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        doc_ids, piece, ids = (table.column(c).to_pylist() for c in ("doc_id", "piece", "ids"))
        h = table.column("h").to_numpy()
        order = np.lexsort((piece, h, -n))  # by falling length, ties in an order of their own
        rows = best_fit(n[order].tolist(), row)
        out = []
        for k, members in enumerate(rows):
            at = [int(order[m]) for m in members]
            lengths = n[at]
            ids_row = b"".join([ids[i] for i in at])
            used = int(lengths.sum())
            places = np.concatenate([np.arange(x, dtype="<u2") for x in lengths] + [np.zeros(row - used, "<u2")])
            rest = np.full(row - used, pad, "<u2").tobytes()
            out.append((k, used, ids_row + rest, places.tobytes(), [0, *np.cumsum(lengths).tolist()], [doc_ids[i] for i in at], [piece[i] for i in at]))
        name = table.column("shard")[0].as_py()
        C.release()
        cols = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array([name] * len(out), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, schema.types[1:], strict=True))], schema=schema)

    sql = "shard long, row int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>"
    return made.groupBy("shard").applyInArrow(shard, sql)


def write(packed: DataFrame, path: str) -> None:
    """One Parquet row per packed row, by shard; works on every store Spark can write."""
    packed.write.mode("overwrite").option("compression", "zstd").parquet(path)


def matrix(rows: list[bytes]) -> np.ndarray:
    """Rows of input_ids or position_ids as one matrix."""
    return np.stack([np.frombuffer(r, "<u2") for r in rows]) if rows else np.zeros((0, 0), "<u2")
