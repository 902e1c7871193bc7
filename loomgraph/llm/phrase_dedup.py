"""Substring dedup by repeated-phrase automata: removes words covered by a window that also starts earlier.

1. Confirm (``repeats``): stretches of text whose trigger recurs are candidates.  Equal stretches are one entry with the
   number of its occurrences.  The passages are the runs of windows whose hashes recur, cut where a window has more than
   one successor or predecessor, so that all windows of a passage occur together; a stretch seen twice, alone with its
   trigger, is one passage as a whole.
2. Compile: each shard's passages go into Aho-Corasick automata (pyahocorasick; one character stands for one word), whole
   triggers each.
3. Stream: every stretch of the shard's triggers, from all documents, runs through their automaton, which locates each
   passage; the earliest place stays, all others are removed.  Only what the automata find is removed.

A document reaches the shards of its own recurring triggers alone, so the work is linear.

Defined results: null text has no words; fewer words than the window lose nothing; order is doc_id (null first), then
start; rows with the same doc_id and text count as one document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

_SURROGATES = range(0xD800, 0xE000)
#: Different stretches behind one trigger that a shard takes.
HOT = 10_000
#: Words that an automaton takes, in whole triggers: it looks for a letter among those that may follow one by one, so a small one is fast.
WORDS = 20_000


def as_letters(lines: list[bytes]) -> str:
    """A character for each different word, and the same one after each line; a shard's bounded size never reaches their number."""
    words = b" ".join([x for line in lines for x in (line, b"\n")]).split(b" ")  # no word is a line feed
    letters = chain(range(1, _SURROGATES.start), range(_SURROGATES.stop, sys.maxunicode + 1))
    known = dict(zip(dict.fromkeys(words), map(chr, letters)))
    return "".join(map(known.__getitem__, words))


def passages(text: str, sizes: np.ndarray, weights: np.ndarray, window: int) -> list[str]:
    """The different passages of a text of lines (a letter after each): stretches of windows that always occur together.

    A window recurs if its hash does, which is a superset.  A passage goes on from one window to the next where both recur,
    all with the hash of the first have the same letter after them and all with the hash of the second the same before
    them.  So one occurrence of a window, whatever its hash, is in the same passage as any other.
    """
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    owns = np.maximum(sizes - window + 1, 0)
    inside = np.repeat(starts - (np.cumsum(owns) - owns), owns) + np.arange(owns.sum())
    if not len(inside):
        return []
    hashes = R.rolling(C.mix64(letters.astype(np.uint64) + np.uint64(1 << 40)), window)[inside]
    order = np.argsort(hashes)
    head = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    lengths = np.diff(np.append(head, len(order)))

    def alone(near: np.ndarray) -> np.ndarray:
        """For each window, whether all with its hash have the same letter there."""
        near = near[order]
        out = np.empty(len(order), bool)
        out[order] = np.repeat(np.minimum.reduceat(near, head) == np.maximum.reduceat(near, head), lengths)
        return out

    recurs = np.empty(len(order), bool)
    recurs[order] = np.repeat(np.add.reduceat(np.repeat(weights, owns)[order], head) >= 2, lengths)
    # the letter after a line's end stands at both ends, and no window goes on beyond it
    onward, backward = alone(letters[inside + window]), alone(letters[inside - 1])
    ends = np.cumsum(owns[owns > 0])
    goes_on = np.zeros(len(order), bool)
    goes_on[:-1] = recurs[:-1] & recurs[1:] & onward[:-1] & backward[1:]
    goes_on[ends - 1] = False
    first = np.flatnonzero(recurs & ~np.concatenate([[False], goes_on[:-1]]))
    last = np.flatnonzero(recurs & ~goes_on)
    return list(dict.fromkeys(text[a:b] for a, b in zip(inside[first].tolist(), (inside[last] + window).tolist(), strict=True)))


def _runs(line: np.ndarray, first: np.ndarray, last: np.ndarray, n_lines: int) -> list[list[int]]:
    """By line, the stretches from first to last, in order, with those that touch or overlap joined."""
    order = np.lexsort((first, line))
    line, first, last = line[order], first[order], last[order]
    far = np.int64(1) << 32  # lines apart
    upto = np.maximum.accumulate(line * far + last)
    new = np.concatenate([[True], (line * far + first)[1:] > upto[:-1] + 1]) if len(line) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    ends = upto[np.append(at, len(line))[1:] - 1] - line[at] * far
    both = np.stack([first[at], ends], 1).ravel().tolist()
    cuts = (2 * np.searchsorted(line[at], np.arange(n_lines + 1))).tolist()
    return [both[a:b] for a, b in zip(cuts, cuts[1:])]


def by_automaton(window: int) -> R.Resolver:
    """Marks of windows located in more than one place, and of those whose first place isn't the phrase's own."""

    def marks_of(members: list[R.Member]) -> list[list[list[int]]]:
        text = as_letters([m[0] for m in members])
        sizes = np.array([m[0].count(b" ") + 1 for m in members], np.int64)
        seen = np.array([m[2] for m in members], np.int64)
        machine = ahocorasick.Automaton()
        found = passages(text, sizes, np.minimum(seen, 2), window)
        if not found:
            return [[[], []] for _ in members]
        for i, passage in enumerate(found):
            machine.add_word(passage, i)
        machine.make_automaton()
        hits = np.fromiter(chain.from_iterable(machine.iter(text)), np.int64).reshape(-1, 2)
        which, end = hits[:, 1], hits[:, 0] + 1
        wide = np.array([len(x) for x in found], np.int64)[which]
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        line = np.searchsorted(starts, end - 1, "right") - 1
        at = end - wide - starts[line]
        times = np.bincount(which, seen[line], len(found))
        # the least place of each passage
        k1, k2, start = (np.array([m[3][i] for m in members], np.int64)[line] for i in range(3))
        order = np.lexsort((start + at, k2, k1, which))
        later = np.ones(len(order), bool)
        later[order[np.flatnonzero(np.concatenate([[True], which[order][1:] != which[order][:-1]]))]] = False
        located = times[which] > 1
        both = [_runs(line[x], at[x], (at + wide - window)[x], len(members)) for x in (located, located & later)]
        return [list(x) for x in zip(*both, strict=True)]

    def resolver(keyed: list[tuple[int, list[R.Member]]]) -> list[list[list[list[int]]]]:
        marks, some, n_words = [], [], 0
        for _, g in keyed:
            some += g
            n_words += sum(m[1] + window - 1 for m in g)
            if n_words >= WORDS:
                marks += marks_of(some)
                some, n_words = [], 0
        each = iter(marks + (marks_of(some) if some else []))
        return [[next(each) for _ in g] for _, g in keyed]

    return resolver


def dedup(docs: DataFrame, window: int = 20, gram: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (start, end word offsets)."""
    fields = [("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string"), ("removed", pa.list_(pa.int64()), "array<long>")]

    def summary(text: bytes) -> tuple:
        words = text.split()
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), []

    def finish(seq: list[bytes], gone: np.ndarray) -> tuple:
        spans = [x + i % 2 for i, x in enumerate(R.runs_of(gone))]
        rest = [0, *spans, len(seq)]
        kept = [w for a, b in zip(rest[::2], rest[1::2], strict=True) for w in seq[a:b]]
        return len(seq), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), spans

    def singly(windows: DataFrame) -> DataFrame:
        place = F.struct("e1", "e2", "e3")
        first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.sum("n_seen").alias("times")).where("times >= 2")
        both = windows.join(first, ["h1", "h2"])
        return both.withColumn("name", F.explode(F.when(place == F.col("first"), F.array(F.lit("located"))).otherwise(F.array(F.lit("located"), F.lit("later")))))

    def spans(name: str) -> Column:
        here = (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")) & (F.col("start") == F.col("e3"))
        return F.when(here, F.col("later")).otherwise(F.col("located")) if name == "later" else F.array().cast("array<int>")

    plan = R.Plan(R.by_words(window, gram), by_automaton(window), singly, HOT, ["located", "later"], "kinds >= 2 or n_seen >= 2", spans, {"later": window}, summary, finish, fields)
    return R.remove(docs, plan)
