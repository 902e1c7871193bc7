"""Substring removal against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import phrase_dedup, repeats, suffix_dedup


def brute_bytes(rows, window):
    places = defaultdict(list)
    for r, (_, text) in enumerate(rows):
        b = (text or "").encode()
        for i in range(len(b) - window + 1):
            places[b[i : i + window]].append((r, i))
    gone = [bytearray(len((t or "").encode())) for _, t in rows]
    for at in places.values():
        if len(at) > 1:
            for r, i in at:
                gone[r][i : i + window] = b"\1" * window
    out = []
    for (d, text), g in zip(rows, gone):
        b = (text or "").encode()
        spans = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((d, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest()))
    return sorted(out, key=str)


def brute_shared(rows, width):
    """How many bytes of each document strings of ``width`` bytes cover that start anywhere else too."""
    return sorted((d, n, removed) for d, n, removed, _, _ in brute_bytes(rows, width))


def brute_words(rows, window):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    seen, out = set(), []
    for d, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("on the of ab ba xx é ß longish wörter".split())
    passages = [" ".join(word() for _ in range(rng.randint(15, 70))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 90))))
        rows.append((i, "\n".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 900), (n + 3, "ab" * 700), (n + 4, rows[3][1]), (n + 5, "x " * 100), (n + 6, "x " * 60 + "y"), (None, rows[5][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, n_words int")


@pytest.mark.parametrize("hot", [50_000, 3])
def test_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(phrase_dedup, "HOT", hot)
    rows = corpus(1)
    got = suffix_dedup.dedup(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, 400)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_words_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(phrase_dedup, "HOT", hot)
    rows = corpus(2)
    got = phrase_dedup.dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, 20)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_shared_bytes_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(phrase_dedup, "HOT", hot)
    rows = [(i, t) for i, (_, t) in enumerate(corpus(4))]
    got = suffix_dedup.dedup(frame(spark, rows)).select("doc_id", "n_bytes", "n_shared").collect()
    assert sorted(tuple(r) for r in got) == brute_shared(rows, 200)
    assert any(r.n_shared for r in got)


def test_nothing_is_removed_without_suffix_ranks(spark, monkeypatch):
    """Passages inside different phrases are found by the ranks alone."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = text(80)
    rows = [(i, f"{text(30)} {passage[:419]} {text(30)}") for i in range(2)]
    docs = frame(spark, rows)
    assert sorted((tuple(r) for r in suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == brute_bytes(rows, 400)
    assert all(r.n_removed >= 400 for r in suffix_dedup.dedup(docs).collect())
    monkeypatch.setattr(suffix_dedup, "by_suffixes", lambda window, shared, gram: lambda groups: [[[[], []] for _ in g] for _, g in groups])
    assert all(r.n_removed == 0 for r in suffix_dedup.dedup(docs).collect())


def test_sides_are_in_the_order_of_the_suffixes():
    rng = random.Random(3)
    parts = list({bytes(rng.choices(b"ab\0", k=rng.randint(0, 30))) for _ in range(200)})
    for back in (False, True):
        side = suffix_dedup.Side(parts, back)
        turned = [p[::-1] if back else p for p in parts]
        assert [turned[i] for i in side.order] == sorted(turned)
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert all(side.common(i, j) == same(turned[i], turned[j]) for i in range(0, len(parts), 7) for j in range(0, len(parts), 5))
        for depth in (1, 5, 12):
            kinds = side.classes(side.neighbours(), depth).tolist()
            for i in range(0, len(parts), 3):
                for j in range(len(parts)):
                    assert i == j or (kinds[i] == kinds[j]) == (len(turned[i]) >= depth and turned[i][:depth] == turned[j][:depth])


def test_classes_and_pairs_mark_the_same_windows(spark, monkeypatch):
    rows = corpus(6)
    want = sorted(map(str, suffix_dedup.dedup(frame(spark, rows)).collect()))
    monkeypatch.setattr(suffix_dedup, "FEW", 1)
    assert sorted(map(str, suffix_dedup.dedup(frame(spark, rows)).collect())) == want


def test_triggers_whose_hashes_collide_are_kept_apart():
    a, b = b"x" * 8 + b"triggerA" + b"y" * 40, b"z" * 8 + b"triggerB" + b"y" * 40
    key = int(repeats.rolling(repeats.byte_units(b"triggerA"), 8).view(np.int64)[0])
    members = [(a, 9, 1, (1, 1, 0)), (a[:-1], 9, 1, (2, 1, 0))]
    assert suffix_dedup.aligned(members, key, 8) == [([0, 1], [8, 8])]
    assert b.find(b"triggerA") < 0


def test_nothing_is_removed_without_automata(spark, monkeypatch):
    """Not even whole copies: what the automata don't locate stays."""
    text = " ".join(f"w{i}" for i in range(100))
    docs = frame(spark, [(1, text), (2, text), (3, "x " + text)])
    assert sorted(r.n_removed for r in phrase_dedup.dedup(docs).collect()) == [0, 100, 100]
    monkeypatch.setattr(phrase_dedup, "by_automaton", lambda window: lambda groups: [[[[], []] for _ in g] for _, g in groups])
    assert all(r.n_removed == 0 for r in phrase_dedup.dedup(docs).collect())


@pytest.mark.parametrize("dedup", [suffix_dedup.dedup, phrase_dedup.dedup])
def test_extra_columns_with_clashing_names(spark, dedup):
    text = " ".join(f"word{i}" for i in range(100))
    plain = frame(spark, [(1, text), (2, text), (3, None)])
    more = plain.select("*", *[F.lit("x").alias(n) for n in ("k1", "k2", "p", "start", "n", "e1", "phrase", "removed", "m", "marks", "n_bytes")])
    assert sorted(map(str, dedup(more).collect())) == sorted(map(str, dedup(plain).collect()))


def test_long_documents_of_words_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 30)
    rows = corpus(5, 20)
    got = phrase_dedup.dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, 20)


def test_long_documents_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 100)
    rows = corpus(3, 20)
    got = suffix_dedup.dedup(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, 400)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_bytes(rows, 400)
    got = phrase_dedup.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_words(rows, 20)


def test_empty_and_repeated_rows(spark):
    empty = frame(spark, [(1, "a")]).where("false")
    assert suffix_dedup.dedup(empty).count() == 0 and phrase_dedup.dedup(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(200))
    twice = frame(spark, [(1, text), (1, text), (1, "other")])
    assert sorted(r.n_removed for r in suffix_dedup.dedup(twice).collect()) == [0, len(text), len(text)]
    assert [r.n_removed for r in phrase_dedup.dedup(twice).collect()] == [0, 0, 0]


def groups_of(rows, window, gram):
    """Triggers with their different phrases, as the shards get them."""
    al = repeats.by_words(window, gram)
    groups = defaultdict(dict)
    for d, text in rows:
        t = (text or "").encode()
        words = t.split()
        for first, n, key, p in zip(*(x.tolist() for x in repeats.phrases_of(*al.units([t]), al)[:4])):
            phrase, _, seen, place = groups[key].get(p, (b" ".join(words[first : first + n - 1 + window]), n, 0, (d, 0, first)))
            groups[key][p] = (phrase, n, seen + 1, place)
    return [(key, list(g.values())) for key, g in sorted(groups.items())]


def brute_marks(groups, window):
    places = defaultdict(list)
    for a, (_, g) in enumerate(groups):
        for b, (phrase, n, seen, (k1, k2, start)) in enumerate(g):
            words = phrase.split(b" ")
            for i in range(n):
                places[tuple(words[i : i + window])].append(((k1, k2, start + i), a, b, i, seen))
    flags = [[[np.zeros(m[1], bool), np.zeros(m[1], bool)] for m in g] for _, g in groups]
    for at in places.values():
        if sum(x[4] for x in at) > 1:
            for place, a, b, i, _ in at:
                flags[a][b][0][i] = True
                flags[a][b][1][i] = place != min(at)[0]
    return [[[repeats.runs_of(f) for f in x] for x in g] for g in flags]


@pytest.mark.parametrize(("bits", "words"), [(64, 20_000), (64, 50), (2, 20_000), (0, 300)])
def test_marks_of_automata_match_brute_force(monkeypatch, bits, words):
    """However many windows share a hash, and however triggers are dealt to automata."""
    groups = groups_of([(i, t) for i, (_, t) in enumerate(corpus(7))], 20, 6)
    want = brute_marks(groups, 20)
    monkeypatch.setattr(phrase_dedup, "WORDS", words)
    rolling = repeats.rolling
    monkeypatch.setattr(repeats, "rolling", lambda units, width: rolling(units, width) & np.uint64(2**bits - 1))
    assert phrase_dedup.by_automaton(20)(groups) == want
    assert any(x[1] for g in want for x in g)


def test_automata_take_a_recurring_stretch_once(monkeypatch):
    """Not each of its windows: an automaton of windows alone has many times the states."""
    made, real = [], phrase_dedup.ahocorasick.Automaton
    monkeypatch.setattr(phrase_dedup.ahocorasick, "Automaton", lambda: made.append(real()) or made[-1])
    passage = " ".join(f"w{i}" for i in range(30)).encode()
    lines = [b"a " + passage, passage + b" b", b"c " + passage + b" d"]
    sizes = [len(x.split()) - 19 for x in lines]
    marks = phrase_dedup.by_automaton(20)([(1, [(x, n, 1, (i, 0, 0)) for i, (x, n) in enumerate(zip(lines, sizes))])])
    assert marks == [[[[1, 11], []], [[0, 10], [0, 10]], [[1, 11], [1, 11]]]]
    assert [[len(x) for x in machine.keys()] for machine in made] == [[30]]


def test_documents_parsed_together_have_the_phrases_of_each(monkeypatch):
    texts = [(t or "").encode() for _, t in corpus(8)]
    for al in (repeats.by_words(20, 6), repeats.by_bytes(200, 64, 400)):
        single = [repeats.phrases_of(*al.units([t]), al) for t in texts]
        for block in (1 << 19, 30):
            monkeypatch.setattr(repeats, "BLOCK", block)
            alone = [repeats.phrases_of(*al.units([t]), al) for t in texts]
            together = repeats.phrases_of(*al.units(texts), al)
            for x, y in zip(zip(*alone), together):
                assert np.array_equal(np.concatenate(x), y)
        monkeypatch.undo()
        assert [int(x[1].sum()) for x in single] == [max(len(al.cut(t)) - al.window + 1, 0) for t in texts]
