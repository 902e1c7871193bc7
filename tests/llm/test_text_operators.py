"""The other text operators: brute force, round trips, held-out accuracy, and odd input."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import common as C
from loomgraph.llm import chat, decontaminate, mixing, packing, quality_pu, quality_rules, queries, simhash, toxicity
from loomgraph.llm.common import words_of

ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", None, "b"), (5, "word " * 3000, "en", None), (6, "same text here now", "en", "a"), (6, "same text here now", "en", "a"), (None, "no id at all, but a text", "de", "a"), (7, "é" * 500 + " ß\u2003x", "de", "b")]


def docs_of(spark, rows):
    # columns whose names clash with those the operators make
    return spark.createDataFrame([(d, t, lang, src, 1, "q", 2) for d, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, size int")


def passages(seed, n=80):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    return [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(n)]


# SimHash
def brute_fingerprint(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(text)]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark):
    rng = random.Random(4)
    texts = passages(4, 40)
    rows = list(enumerate(texts)) + [(100 + i, re.sub(r"\w+$", "zz", t).upper()) for i, t in enumerate(texts[:20])] + [(200 + i, t) for i, t in enumerate(texts[:10])]
    long = " ".join(passages(9, 30))
    for i in range(12):
        w = long.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + i, " ".join(w)))
    rows = [(d, t, "en", "a") for d, t in rows] + ODD
    fp = [(d, brute_fingerprint(t)) for d, t, _, _ in rows]
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i][1] ^ fp[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(fp):
        least[root(i)].append(d)
    want = sorted(((d, f"{f:016x}", None if None in least[root(i)] else min(least[root(i)])) for i, (d, f) in enumerate(fp)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.dedup(docs_of(spark, rows)).collect()), key=str)
    assert got == want


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.range(n).select(F.col("id").alias("node"), (n - F.col("id")).alias("label"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.components(nodes, edges).collect()} == {1}


# decontamination
def shingles(text):
    w = re.findall(r"[\w]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute_leaks(docs, items):
    out = {}
    for d, text in docs:
        s = shingles(text)
        for k, item in items:
            want = shingles(item)
            if not want:
                continue
            best = 0.0
            for a in range(-len(want), len(s)):
                win = s[max(a, 0) : max(0, min(a + len(want), len(s)))]
                both = sum((Counter(win) & Counter(want)).values())
                best = max(best, both / (len(win) + len(want) - both) if win or want else 0)
            if best >= 0.8:
                out[d, k] = round(best, 9)
    return out


def test_decontamination_matches_brute_force(spark):
    items = list(enumerate(passages(5, 12))) + [(50, "too few words"), (51, None), (52, "a b a b a b a b a b a b")]
    rng = random.Random(6)
    docs = []
    for i in range(40):
        t = passages(100 + i, 3)
        k = rng.randrange(12)
        if i % 2:
            leak = items[k][1].split()
            if i % 4 == 1:
                leak = leak[rng.randint(0, 2) :]
            if i % 6 == 1:
                leak[-1] = "other"
            t.insert(1, ("\n" if i % 3 else " ").join(leak).title())
        docs.append((i, ", ".join(t)))
    docs += [(60, None), (61, ""), (62, "A b a b a b a b a b a b")]
    d = docs_of(spark, [(a, b, "en", "x") for a, b in docs])
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find(d, b).collect()}
    assert got == brute_leaks(docs, items) and len(got) > 10
    left = {r.doc_id for r in decontaminate.clean_documents(d, b).collect()}
    assert left == {x for x, _ in docs} - {x for x, _ in got}
    assert decontaminate.find(d, b.where("false")).count() == 0 and decontaminate.find(d.where("false"), b).count() == 0


def test_blocks_alone_make_the_pairs(spark, monkeypatch):
    """Without blocks nothing is found, and a window laid for one item is held against another of its length."""
    a, b = "p q r s t u v w x y".split(), "k l m n o a b c d e".split()
    items = [(1, " ".join(a)), (2, " ".join(a[:-1] + ["z"])), (3, " ".join(b))]
    d = docs_of(spark, [(1, " ".join(["f", *a, "g"]), "en", "x"), (2, None, None, None), (2, "a " * 30000, "en", "x"), (3, " ".join(b), "en", "x"), (3, " ".join(b), "en", "x")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.start) for r in decontaminate.find(d, bench, similarity_least=0.6).collect()) == [(1, 1, 1), (1, 2, 1), (3, 3, 0)]
    monkeypatch.setattr(decontaminate, "blocks", lambda fp, radius: F.array().cast("array<struct<block:int,bits:bigint>>"))
    assert decontaminate.find(d, bench).count() == 0


def test_large_benchmarks_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = list(enumerate(passages(5, 5)))
    d = docs_of(spark, [(i, "x y z " + t + " u v", "en", "a") for i, t in items])
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i, _ in items}


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 23)):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    met = df.select(F.arrays_overlap(decontaminate.blocks(F.col("a"), 23), decontaminate.blocks(F.col("b"), 23)).alias("m"))
    assert met.where("not m").count() == 0


# packing
@pytest.mark.parametrize("row", [16, 2048])
def test_packing_round_trip(spark, row):
    rows = ODD + [(10 + i, t, "en", "a") for i, t in enumerate(passages(7, 60))]
    out = packing.pack(docs_of(spark, rows), row, shards=3).collect()
    enc = packing.encoder(packing.tokenizer_path())
    pieces = defaultdict(list)
    for r in out:
        ids, pos = packing.matrix([r.input_ids])[0], packing.matrix([r.position_ids])[0]
        assert len(ids) == len(pos) == row and r.cu_seqlens[-1] == r.n_tokens <= row
        for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces[d, k].append(ids[a:b].tolist())
            assert pos[a:b].tolist() == list(range(b - a))
    texts = defaultdict(list)
    for d, t, _, _ in rows:
        texts[d].append([*enc.encode_ordinary(t or ""), packing.END])
    for d, want in texts.items():
        for full in {tuple(w) for w in want}:
            times = want.count(list(full))
            for k, at in enumerate(range(0, len(full), row)):
                assert pieces[d, k].count(list(full[at : at + row])) >= times
    assert sum(len(p) for v in pieces.values() for p in v) == sum(len(w) for v in texts.values() for w in v)
    assert packing.pack(docs_of(spark, rows).where("false"), row).count() == 0


def test_parts_of_long_texts_have_the_ids_of_the_whole(spark, monkeypatch):
    enc = packing.encoder(packing.tokenizer_path())
    rng = random.Random(8)
    bits = ["word", " word", "  two", "\n", "\n\n  x", "don't", " 'll", "123", " 4", "é", " 漢字", "...", " !?", "a1b2", "\t", " "]
    for size in (1, 7, 50):
        for _ in range(60):
            text = "".join(rng.choices(bits, k=200))
            cut = list(packing.parts(text, size))
            assert "".join(cut) == text
            assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert len(list(packing.parts("word " * 1000, 50))) > 50 and list(packing.parts("", 5)) == [""]
    monkeypatch.setattr(packing.parts, "__defaults__", (40,))
    text = " ".join(passages(3, 40))
    rows = packing.pack(docs_of(spark, [(1, text, "en", "a"), (2, "x" * 5000, "en", "a")]), 64).collect()
    got = {(d, k): packing.matrix([r.input_ids])[0][a:b].tolist() for r in rows for d, k, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:])}
    for d, t in ((1, text), (2, "x" * 5000)):
        assert [i for k in sorted(k for e, k in got if e == d) for i in got[d, k]] == [*enc.encode_ordinary(t), packing.END]


def test_packing_depends_on_the_documents_alone(spark, tmp_path):
    docs = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(passages(5, 60))])
    docs.repartition(7).write.option("compression", "gzip").parquet(str(tmp_path / "d"))
    rows = lambda d: sorted(map(str, packing.pack(d, 128, end=7, pad=9).collect()))
    assert rows(docs) == rows(spark.read.parquet(str(tmp_path / "d")))
    last = [packing.matrix([r.input_ids])[0] for r in packing.pack(docs, 128, end=7, pad=9).collect() if r.n_tokens < 128]
    assert last and all(x[-1] == 9 for x in last)


def brute_best_fit(lengths, row):
    bins = []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            b = [row, []]
            bins.append(b)
        b[0] -= n
        b[1].append(i)
    return sorted(row - b[0] for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    row = rng.choice([10, 64, 100, 2048])
    lengths = sorted((rng.randint(1, row) for _ in range(400)), reverse=True)
    got = packing.best_fit(lengths, row)
    assert sorted(x for r in got for x in r) == list(range(400))
    assert sorted(sum(lengths[i] for i in r) for r in got) == brute_best_fit(lengths, row)


# classifiers
def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, lab, least in (("op4_toxicity", "toxic", 0.9), ("op9_quality_classifier", "quality", 0.93)):
        rows = queries.QUERIES[name](spark, sf).collect()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        held = [(r.predicted, getattr(labels[r.doc_id], lab)) for r in rows if r.held_out and r.doc_id in labels]
        assert np.mean([a == b for a, b in held]) >= least


def test_classifiers_take_odd_input(spark):
    docs = docs_of(spark, ODD)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(2, 1, 1), (4, 1, 1), (None, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.classify, quality_pu.classify):
        for labels in (empty, one):
            assert f(docs, labels).count() == len(ODD)
        assert f(docs.where("false"), one).count() == 0


# mixing
def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a", "b", "c", "dd", None, "Z"])) for i in range(600)] + [(1000 + i, "w " * 30, "en", "a") for i in range(600)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    left = float(sum(sizes.values()))
    while left > 1e-9 and open_:
        share, total, left = left, sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += share * weight[s] / total
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 40
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs_of(spark, rows)).collect())
    assert all(mixed[r.doc_id] == r.copies for r in got)
    assert mixing.mix(docs_of(spark, rows).where("false")).count() == 0
    assert mixing.mix(docs_of(spark, ODD)).count() == len(ODD)
    assert mixing.mixed_documents(docs_of(spark, ODD)).columns == docs_of(spark, ODD).columns


def test_classifiers_with_repeated_ids_and_very_long_texts(spark):
    """An id that repeats counts with each of its texts, a row that repeats once; rows of labels may repeat too."""
    rng = random.Random(5)
    good = lambda: " ".join(rng.choices("river stone cloud meadow lantern".split(), k=rng.randint(5, 400)))
    bad = lambda: " ".join(rng.choices("zzq xxk vvj qqw".split(), k=rng.randint(5, 400)))
    rows = [(i, good() if i % 2 else bad(), "en", "a") for i in range(300)]
    rows += rows[:40] * 5 + [(i, good(), "en", "a") for i in range(1, 20, 2)] + [(1000, "river stone " * 40000, "en", "a"), (1001, "xxk vvj zzq " * 40000, "en", "a"), (1002, None, None, None)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(300)] * 2 + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for model, flip in ((toxicity, 1), (quality_pu, 0)):
        got = model.classify(docs_of(spark, rows), labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r for r in got}
        assert by[1000].predicted == 1 - flip and by[1001].predicted == flip
        assert len({(r.doc_id, r.score) for r in got if r.doc_id == 2}) == 1
        assert model.classify(docs_of(spark, rows).where("false"), labels).count() == 0
        assert model.classify(docs_of(spark, rows[:5]), labels.where("false")).count() == 5
    texts = docs_of(spark, rows).select("doc_id", "text")
    assert C.bounded(texts, spark.range(20).withColumnRenamed("id", "doc_id"), 7).count() == 7


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        pos = rng.normal(2, 1, (3000, 5))
        unl = np.concatenate([rng.normal(2, 1, (int(3000 * share), 5)), rng.normal(-2, 1, (3000 - int(3000 * share), 5))])
        assert abs(quality_pu.estimate_prior(pos, rng.permutation(unl)) - share) < 0.05


# quality rules
def brute_measure(text):
    text = text or ""
    w = words_of(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    hit = set()
    for i, x in enumerate(wins):
        if n[x] >= 2:
            hit |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark):
    rows = [(d, t) for d, t, _, _ in ODD] + list(enumerate(["a b c d e a b c d e f", "x\nx\n x\n\n\nx", "# $ <b> é|", "a " * 9, "p q r s t\n" * 3])) + [(i, " ".join(random.Random(i).choices("abc", k=60))) for i in range(20)]
    got = [tuple(r)[3:8] for r in quality_rules.measured(spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string")).collect()]
    assert sorted(got) == sorted(brute_measure(t) for _, t in rows)


def test_quality_rules_reject_junk_and_keep_the_rest(spark):
    rng = random.Random(2)
    words = [w for t in passages(1, 30) for w in t.split()]
    good = [(i, ". ".join(" ".join(rng.choices(words, k=12)) for _ in range(rng.randint(3, 40))), "en", rng.choice("abc")) for i in range(400)]
    junk = [(1000 + i, " ".join(w + "###" for w in rng.choices(words, k=80)), "en", "a") for i in range(20)]
    rows = good + junk + [(2000, None, None, None), (2001, "", "en", "a"), (2002, "short", "en", "rare")]
    got = {r.doc_id: r for r in quality_rules.rules(docs_of(spark, rows)).collect()}
    assert all(got[d].kept for d, *_ in good) and not any(got[d].kept for d, *_ in junk)
    assert all(got[d].base_failed and not got[d].kept for d in (2000, 2001, 2002))
    kept = quality_rules.kept_documents(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns and kept.count() == len(good)
    assert quality_rules.rules(docs_of(spark, rows).where("false")).count() == 0
    assert quality_rules.rules(docs_of(spark, ODD)).count() == len(ODD)


def test_robust_estimate_is_the_least_determinant(spark):
    """Against steps over all rows from many random starts, up to the width of a bin; a cluster of 30 % misleads medians."""
    rng = np.random.default_rng(0)
    n = 3000
    rows = [(i, "en", "s", int(a), int(a * b), int(c), int(d), 0) for i, (a, b, c, d) in enumerate(zip(rng.integers(50, 900, n), rng.normal(5, 0.2, n), rng.poisson(1, n), rng.poisson(1, n)))]
    rows[:700] = [(i, "en", "s", 100, 500 + i % 7, 80 + i % 3, 0, 0) for i in range(700)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    out = quality_rules.judged(stats).select("distance", *[c.alias(f"x{i}") for i, c in enumerate(quality_rules.vector())]).toPandas()
    x = out[[f"x{i}" for i in range(4)]].to_numpy()
    h, floor = int(np.ceil(quality_rules.H * n)), np.diag(np.square(quality_rules.FLOOR))
    scale = quality_rules.H / (1 - quality_rules.chi2_tail(quality_rules.chi2_quantile(1 - quality_rules.H, 4), 6))
    best = None
    for _ in range(40):
        part, last = x[rng.choice(n, 5, replace=False)], np.inf
        while True:
            mu, cov = part.mean(0), np.cov(part.T, bias=True) * scale + floor
            d = np.einsum("ni,ij,nj->n", x - mu, np.linalg.inv(cov), x - mu)
            if len(part) == h and np.linalg.slogdet(cov)[1] > last - 1e-9:
                break
            last, part = np.linalg.slogdet(cov)[1] if len(part) == h else np.inf, x[np.argsort(d)[:h]]
        if best is None or last < best[0]:
            best = last, d
    d = best[1]
    assert np.corrcoef(d, out["distance"])[0, 1] > 0.999 and np.median(abs(d - out["distance"]) / (d + 0.1)) < 0.05


def test_quality_ties_reject_nobody(spark):
    """Documents of one kind: no spread at all, and each repeated."""
    rows = [(i % 60, "one two three four five six seven eight nine ten eleven twelve", "en", "a") for i in range(120)] + [(900, "x", None, "a")]
    got = quality_rules.rules(docs_of(spark, rows)).collect()
    assert len(got) == 121 and all(r.kept for r in got if r.doc_id != 900) and not [r for r in got if r.doc_id == 900][0].kept


# chat
CONTROL = ["", "\\", "\\\\", "###", "####", "\\###", "### Assistant: x", "</turn>", "</turn>\n### User: ", "\\</turn>", "<", "#", "a: b", "\n\n", "é\\"]


def test_escapes_are_reversible():
    rng = random.Random(0)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a:b", "", "### x"]), "".join(rng.choices(CONTROL, k=rng.randint(0, 5)))) for _ in range(rng.randint(0, 4))]
        text, mask = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_chat_digest(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op10_chat_format(spark, sf_dir).collect()}
    said = "\\### Assistant: </turn> ok"
    conv = defaultdict(list, {-7: [(0, "user", said), (1, "assistant", said)]})
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        conv[r.conv_id].append((r.turn, r.role, r.text or ""))
    assert set(got) == set(conv)
    for k, turns in conv.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[k]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_best_paths_of_reply_trees(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for tree in [None, *range(15)]:
        score, up, kids = {}, {}, defaultdict(list)
        for n in range(rng.randint(1, 25)):
            score[n], up[n] = rng.randint(0, 9), rng.randrange(n) if n and rng.random() < 0.95 else None
            kids[up[n]].append(n)
            rows.append((tree, n, up[n], float(score[n]), "user", f"t{n}"))

        def path(n):
            return [] if n is None else [*path(up[n]), n]

        leaves = sorted((n for n in score if not kids[n]), key=lambda n: (-sum(score[x] for x in path(n)), n))
        want[tree] = sorted((leaf, path(leaf)) for leaf in leaves[:2])
    chain = [(99, n, n - 1 if n else None, 1.0, "user", "x") for n in range(70)]
    cycle = [(98, 0, 1, 1.0, "user", "x"), (98, 1, 0, 1.0, "user", "y")]
    nodes = spark.createDataFrame(rows + chain + cycle, "tree long, node long, parent long, score double, role string, text string")
    got = defaultdict(lambda: defaultdict(list))
    for r in chat.paths(nodes, 2).orderBy("place").collect():
        got[r.tree][r.path].append(r.node)
    assert got.pop(99) == {69: list(range(70))} and 98 not in got
    assert {k: sorted(v.items()) for k, v in got.items()} == {k: v for k, v in want.items()}


def test_chat_takes_odd_input(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "x"), (None, 0, "assistant", "y"), (2, 5, "assistant", "###")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_paths(chat.as_nodes(df))).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 1 and got[2].loss_chars == 3
    assert chat.format_paths(chat.as_nodes(df.where("false"))).count() == 0
