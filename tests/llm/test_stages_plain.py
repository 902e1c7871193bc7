"""The decontamination and mixing stages against plain Python that calls none of their operators."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def grams(text):
    w = text.split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def holds(text, item):
    g, want = grams(text), Counter(grams(item))
    n = sum(want.values())
    # a window may hang over either end of the document
    windows = (Counter(g[max(0, i) : max(0, i + n)]) for i in range(1 - n, len(g)))
    return any(5 * (w & want).total() >= 4 * (w | want).total() for w in windows)


def test_decontamination(spark, tmp_path):
    rng = random.Random(5)
    items = [text_of(rng, 40) for _ in range(4)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = []
    for i in range(24):
        w = items[i % 4].split()
        for at in rng.sample(range(40), i % 5 if i < 20 else 0):
            w[at] = "other"
        passage = " ".join(w) if i < 20 else text_of(rng, 40)
        rows.append((None if i % 6 == 0 else i, f"{text_of(rng, 30)} {passage} {text_of(rng, 20)}", "a"))
    want = sorted(t for _, t, _ in rows if not any(holds(t, item) for item in items))
    assert 4 < len(want) < 20
    assert sorted(r.text for r in corpus_pipeline.decontamination(spark, docs_of(spark, rows), str(tmp_path)).collect()) == want


def test_mixing(spark, sf_dir):
    rng = random.Random(6)
    rows = [(i, text_of(rng, rng.randint(5, 90)), rng.choice("aabbbbbccc")) for i in range(150)]
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight, target, left = dict(zip("abc", (5, 2, 1))), {}, size.total()
    while len(target) < 3:
        open_ = [s for s in weight if s not in target]
        rate = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * size[s] < weight[s] * rate]
        target |= {s: 3 * size[s] for s in full} if full else {s: weight[s] * rate for s in open_}
        left -= sum(target[s] for s in full)
    want = Counter()
    for s in weight:
        mine, ratio = [(d, t, len(t.split())) for d, t, x in rows if x == s], target[s] / size[s]
        merit = {d: n * 1_000_000 // (n + 200) for d, _, n in mine}
        mean, lean = sum(merit[d] * n for d, _, n in mine) / size[s], min(1.0, 3 / ratio - 1)
        due = {d: ratio * (1 + lean * (merit[d] - mean) / 1e6) for d, _, _ in mine}
        assert abs(sum(due[d] * n for d, _, n in mine) - target[s]) < 1e-6 and max(due.values()) <= 3
        assert len({x % 1 for x in due.values()}) > 3 or ratio == 3
        rest, upto, odds = target[s] - sum(math.floor(due[d]) * n for d, _, n in mine), 0, {}
        for d, t, n in mine:
            u, p = (int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, due[d] % 1
            odds[d], want[d, t] = u / (1 - u) / (p / (1 - p)) if p else math.inf, math.floor(due[d])
        for d, t, n in sorted((r for r in mine if odds[r[0]] < math.inf), key=lambda r: odds[r[0]]):
            upto += n
            want[d, t] += 2 * upto - n <= 2 * rest
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mixture(spark, docs_of(spark, rows), sf_dir).collect())
    assert got == +want
