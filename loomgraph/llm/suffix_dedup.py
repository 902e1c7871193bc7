"""Suffix-array dedup: exact removal of long byte strings that occur again anywhere in the corpus.

Prefix-free parsing (``repeats``): rolling-hash triggers cut the corpus into phrases; the parse is each document's
sequence of phrases, the dictionary the different phrases.  The order of the corpus to the window's depth is put
together from both:

* dictionary: its suffixes that begin at a trigger are sorted, with the lengths of their common prefixes, and so are the
  texts before the trigger, read backwards.  Equal windows have their trigger at the same place, so the class of any
  other suffix at the window's depth follows from these two orders: from the class of the bytes before the trigger and
  that of the trigger's suffix, each to its own depth.  Shard by shard; a shard holds all phrases of its triggers.
* parse: the number of times each phrase occurs in it.  Phrases overlap by window - 1 bytes, so one phrase covers all
  that a window reaches; the first level of the parse's order, equal phrases side by side, is the only one that can
  decide anything.  Its further levels would only put strings in order that agree for a whole window already, so no
  suffix array of the parse beyond that level is built.

A window is removed if it lies in a phrase that the parse holds twice, or its class holds two phrases.

Shorter repeats stay; ``n_shared`` tells of them: the bytes that strings of ``shared`` bytes or more which occur again
cover, read off the same orders at that depth.

Defined results: null text counts as empty; a text shorter than the window loses nothing; all occurrences of a repeated
string go, the first included; rows that repeat a doc_id are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats as R


#: Different phrases behind one trigger that a shard takes: some 25 MB.
HOT = 50_000
#: Phrases behind one trigger that are compared pair by pair; more are put into classes depth by depth.
FEW = 24


class Side:
    """Strings in order, with what neighbours have in common from the front; strings are given by their ends if ``back``."""

    def __init__(self, parts: list[bytes], back: bool) -> None:
        self.sizes = [len(x) for x in parts]
        self.width = max(self.sizes)
        self.order = sorted(range(len(parts)), key=[x[::-1] for x in parts].__getitem__ if back else parts.__getitem__)
        self.codes = [int.from_bytes(x.rjust(self.width, b"\0"), "little") if back else int.from_bytes(x.ljust(self.width, b"\0"), "big") for x in parts]

    def common(self, i: int, j: int) -> int:
        """How many bytes strings i and j agree in."""
        differ = self.codes[i] ^ self.codes[j]
        return min(self.sizes[i], self.sizes[j], self.width - ((differ.bit_length() + 7) >> 3))

    def neighbours(self) -> np.ndarray:
        """For each in order, what it has in common with the one before; 0 for the first."""
        return np.array([0, *(self.common(i, j) for i, j in zip(self.order, self.order[1:]))], np.int64)

    def classes(self, common: np.ndarray, depth: int) -> np.ndarray:
        """By string: equal numbers for those that agree to the depth."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(common < depth)
        return out


def aligned(members: list[R.Member], key: int, gram: int) -> list[tuple[list[int], list[int]]]:
    """Members whose trigger is the same string, and where each has it (several lists only if hashes collide)."""
    rest, out = list(range(len(members))), []
    while rest:
        phrase, n, *_ = members[rest[0]]
        hashes = R.rolling(R.byte_units(phrase), gram).view(np.int64)
        # of equal strings a window's trigger is the leftmost, and the phrase's last window begins before it
        at = int(n - 1 + np.flatnonzero(hashes[n - 1 :] == key)[0])
        trigger, mine, places, other = phrase[at : at + gram], [], [], []
        for i in rest:
            at = members[i][0].find(trigger, members[i][1] - 1)
            if at < 0:
                other.append(i)
            else:
                mine.append(i)
                places.append(at)
        out.append((mine, places))
        rest = other
    return out


def _merged(runs: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(runs):
        if out and a <= out[-1] + 1:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def by_suffixes(window: int, shared: int, gram: int) -> R.Resolver:
    """Marks of the windows of ``window`` and of ``shared`` bytes."""

    def pairwise(members: list[R.Member], at: list[int], left: Side, right: Side) -> list[list[list[tuple[int, int]]]]:
        runs: list[list[list[tuple[int, int]]]] = [[[], []] for _ in members]
        ranked = right.order
        common = right.neighbours().tolist()
        for x, i in enumerate(ranked):
            after = right.width
            for y in range(x + 1, len(ranked)):
                after = min(after, common[y])  # of i and j, as all between agree as far
                j = ranked[y]
                if after + min(at[i], at[j]) < shared:
                    if after + max(at) < shared:
                        break
                    continue
                before = left.common(i, j)
                if before + after < shared:
                    continue
                for k, depth in enumerate((window, shared)):
                    for m in (i, j):
                        # from so many bytes before the trigger to so many
                        first, last = max(0, at[m] - before), min(at[m] - depth + after, members[m][1] - 1, len(members[m][0]) - depth)
                        if first <= last:
                            runs[m][k].append((first, last))
        return runs

    def classwise(members: list[R.Member], at: list[int], left: Side, right: Side) -> list[list[list[tuple[int, int]]]]:
        runs: list[list[list[tuple[int, int]]]] = [[[], []] for _ in members]
        places, sizes = np.array(at), np.array([len(m[0]) for m in members])
        owns = np.array([m[1] for m in members])
        before, after = left.neighbours(), right.neighbours()
        for d in range(int((places - owns).min()) + 1, int(places.max()) + 1):
            start = places - d
            lefts = left.classes(before, d)
            for k, depth in enumerate((window, shared)):
                mine = np.flatnonzero((start >= 0) & (start < owns) & (start + depth <= sizes))
                kind = lefts[mine] * len(members) + right.classes(after, depth - d)[mine]
                _, inverse, counts = np.unique(kind, return_inverse=True, return_counts=True)
                for i in mine[counts[inverse] >= 2].tolist():
                    runs[i][k].append((at[i] - d, at[i] - d))
        return runs

    def resolver(groups: list[tuple[int, list[R.Member]]]) -> list[list[list[list[int]]]]:
        out = []
        for key, members in groups:
            marks: list[list[list[int]]] = [[[], []] for _ in members]
            for mine, at in aligned(members, key, gram):
                if len(mine) > 1:
                    some = [members[i] for i in mine]
                    left, right = Side([m[0][:a] for m, a in zip(some, at, strict=True)], True), Side([m[0][a:] for m, a in zip(some, at, strict=True)], False)
                    found = (pairwise if len(mine) <= FEW else classwise)(some, at, left, right)
                    for i, runs in zip(mine, found, strict=True):
                        marks[i] = [_merged(r) for r in runs]
            out.append(marks)
        return out

    return resolver


def dedup(docs: DataFrame, window: int = 400, shared: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and removed (start, end byte offsets)."""
    if not 8 <= gram <= shared <= window:
        raise ValueError("8 <= gram <= shared <= window")
    fields = [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("kept_sha256", pa.string(), "string"), ("n_shared", pa.int64(), "long"), ("removed", pa.list_(pa.int64()), "array<long>")]

    def summary(text: bytes) -> tuple:
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), 0, []

    def finish(seq: bytes, gone: np.ndarray, again: np.ndarray) -> tuple:
        runs = R.runs_of(gone)
        spans = [x + i % 2 for i, x in enumerate(runs)]
        kept = np.frombuffer(seq, np.uint8)[~gone].tobytes()
        return len(seq), int(gone.sum()), len(runs) // 2, hashlib.sha256(kept).hexdigest(), int(again.sum()), spans

    def singly(windows: DataFrame) -> DataFrame:
        by = ["h1", "h2", "width"]
        twice = windows.groupBy(*by).agg(F.sum("n_seen").alias("times")).where("times >= 2").select(*by)
        return windows.join(twice, by).withColumn("name", F.when(F.col("width") == window, "marks").otherwise("shorter"))

    def spans(name: str) -> Column:
        return F.when(F.col("n_seen") >= 2, F.array(F.lit(0), F.col("n") - 1)).otherwise(F.col(name))

    plan = R.Plan(
        R.by_bytes(shared, gram, window), by_suffixes(window, shared, gram), singly, HOT, ["marks", "shorter"], "kinds >= 2", spans, {"marks": window, "shorter": shared}, summary, finish, fields,
    )
    return R.remove(docs, plan)
