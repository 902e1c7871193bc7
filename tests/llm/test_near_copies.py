"""Near copies by ball hashing, and the near-dedup stage, against brute-force Jaccard similarity.

The balls find similar texts by chance: what they tie must be similar, and few similar texts may be missed.
"""

import random
import re

import corpus_pipeline
from loomgraph.llm import simhash
from loomgraph.llm.common import words_of


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def components(sets):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return root


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def changed(rng, text, k):
    w = text.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def planted(seed):
    """Texts with copies changed in 0 to 6 places (similarity about 1 to 0.5), chains of copies, a common line, odd texts."""
    rng = random.Random(seed)
    line, out = text_of(rng, 12), []
    for _ in range(25):
        base = text_of(rng, rng.randint(20, 200))
        if rng.random() < 0.5:
            base = f"{line} {base} {line}"
        out.append(base)
        for _ in range(rng.randint(1, 5)):
            out.append(changed(rng, rng.choice(out[-2:]), rng.randint(0, 6)))
    base = text_of(rng, 150)
    out += [changed(rng, base, 2) for _ in range(40)] + [base.upper(), line, line, "one two", "One  two", "", None]
    rng.shuffle(out)
    return out


def checked(texts, found):
    """found: for each text what names its component.  Tied texts are so by brute force; returns the share of pairs missed."""
    root, pairs, missed = components([shingles(t) for t in texts]), 0, 0
    for i in range(len(texts)):
        for j in range(i):
            if found[i] == found[j]:
                assert root[i] == root[j]
            if root[i] == root[j]:
                pairs, missed = pairs + 1, missed + (found[i] != found[j])
    return missed / pairs


def test_components_are_similar_and_few_are_missed(spark):
    shares = []
    for seed in (1, 2):
        texts = planted(seed)
        rows = simhash.near_copies(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
        of = {r.label.id: r.root.id for r in rows}
        first = {}
        for i, t in enumerate(texts):
            first.setdefault(frozenset(shingles(t)), i)
        assert sorted(of) == sorted(first.values())
        shares.append(checked(texts, [of[first[frozenset(shingles(t))]] for t in texts]))
    assert max(shares) < 0.1


def test_one_table_of_64_bits_misses_most(spark):
    """Why the stage has several short fingerprints."""
    texts = [t for t in planted(1) if len(words_of(t)) > 5]
    rows = simhash.near_copies(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), tables=1, bits=64, print_words=5).collect()
    few = simhash.near_copies(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert len({r.root.id for r in rows}) > 1.3 * len({r.root.id for r in few})


def test_stage_keeps_one_of_each_group_of_near_copies(spark, sf_dir):
    texts = planted(3)
    of = {r.label.id: r.root.id for r in simhash.near_copies(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    kept = corpus_pipeline.near_dedup(spark, docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(of.values()))
    root = components([shingles(t) for t in texts])
    assert {root.index(r) for r in set(root)} <= set(of.values()) and len(set(of.values())) < 1.1 * len(set(root))


def test_odd_input(spark, sf_dir):
    rows = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "a b c", "s"), (5, "x " * 60000, "s"), (6, "x " * 60001, "s"), (6, "x " * 60001, "s")]
    docs = docs_of(spark, rows).withColumnRenamed("source", "row").withColumnsRenamed({"lang": "key", "n_chars": "label"})
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text and r.text[:5]) for r in kept.collect()) == [(0, "a b c"), (2, None), (5, "x x x")]


def test_no_rows(spark, sf_dir):
    assert corpus_pipeline.near_dedup(spark, docs_of(spark, []), sf_dir).count() == 0


def test_one_row_of_each_component_under_null_and_repeated_ids(spark, sf_dir):
    texts = planted(4)
    ids = [(None, 5, i)[i % 3] for i in range(len(texts))]
    docs = docs_of(spark, [(d, t, "a") for d, t in zip(ids, texts)] * 2)
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    root = components([shingles(t) for t in texts])
    named = {(d, t or ""): root[i] for i, (d, t) in enumerate(zip(ids, texts))}
    held = [named[r.doc_id, r.text or ""] for r in kept]
    assert set(held) == set(root) and len(held) < 1.1 * len(set(root))
    least = {r: min(-1 if d is None else d for d, q in zip(ids, root) if q == r) for r in set(root)}
    first = {}
    for r in kept:
        k, d = named[r.doc_id, r.text or ""], -1 if r.doc_id is None else r.doc_id
        first[k] = min(first.get(k, d), d)
    assert first == least


def test_exact_copies_under_one_repeated_id(spark, sf_dir):
    rows = [(3, "t u v w x y z", "a"), (7, "s s s", "a"), (7, "t u v w x y z", "a")]
    kept = corpus_pipeline.near_dedup(spark, docs_of(spark, rows), sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, "t u v w x y z"), (7, "s s s")]


def test_the_exact_setting_misses_no_similar_pair(spark, sf_dir):
    """One print of 64 bits finds few: the rest has to come from the prefixes."""
    texts = planted(1) + ["a b c d e f g h", "a b c d e f g h i", "b c d e f g h", "p q r s t u", "p q r s t u v"]
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    sets = [shingles(t) for t in texts]
    for setting in ({"tables": 1, "bits": 64, "print_words": 5}, {}):
        rows = simhash.near_copies(docs, exact=True, **setting).collect()
        of, first = {r.label.id: r.root.id for r in rows}, {}
        for i, x in enumerate(sets):
            first.setdefault(frozenset(x), i)
        assert checked(texts, [of[first[frozenset(x)]] for x in sets]) == 0
    root = components(sets)
    for setting in ({"tables": 1, "bits": 64, "print_words": 5}, {}):
        kept = simhash.without_near_copies(docs, **setting)
        assert sorted(r.doc_id for r in kept.collect()) == sorted({root.index(r) for r in root})


def test_candidates_grow_with_a_group_not_with_its_pairs(spark, monkeypatch):
    """Copies of one text with two changes each: similar to the text, not to each other."""
    rng, made = random.Random(5), {}
    base = text_of(rng, 150)
    texts = [base] + [changed(rng, base, 2) for _ in range(250)] + [text_of(rng, 60) + " " + " ".join(base.split()[:90]) for _ in range(50)]
    write = simhash.C.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(simhash.C, "materialize", counted)
    rows = simhash.near_copies(docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]), exact=True, tables=1, bits=64, print_words=5).collect()
    assert checked(texts, [{r.label.id: r.root.id for r in rows}[i] for i in range(len(texts))]) == 0
    assert made.get("tied", 0) + made["missed"] < 5 * len(texts)
