"""The stages, one after the other, against what each must keep."""

import random

import corpus_pipeline
from loomgraph.llm import decontaminate, packing, quality_rules, simhash


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if i < 4:
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in quality_rules.rules(before).where("kept").collect()}
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in docs.collect()) == sorted({r.root.id for r in simhash.near_copies(before).collect()})
        if name == "decontamination":
            bad = {r.doc_id for r in decontaminate.find(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in before.collect() if r.doc_id not in bad)
    enc = packing.encoder(packing.tokenizer_path())
    want = sum(len(enc.encode_ordinary(r.text)) + 1 for r in seen["mixing"].collect())
    assert sum(r.n_tokens for r in docs.collect()) == want


def test_run_gives_packed_rows(spark, sf_dir):
    assert {"input_ids", "cu_seqlens", "position_ids"} <= set(corpus_pipeline.run(spark, sf_dir).columns)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty texts, repeated rows and ids, columns whose names clash with those the stages make."""
    text = lambda k: " ".join("".join(x) for x in zip(*[iter(random.Random(k).choices("abcdefghij", k=200))] * 5))
    rows = [(i, text(i), "en" if i % 3 else None, "s" if i % 2 else None) for i in range(40)] + [(None, None, None, None), (None, text(50), None, "s"), (7, text(51), "en", "s"), (7, text(51), "en", "s"), (41, "", "en", "s")]
    docs = spark.createDataFrame([(d, t, l, s, 1, "x", 2, 3, "y") for d, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _lead string, k1 long, size long, row string")
    for given in (docs, docs.where("false")):
        now = given
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, sf_dir)
            if i < 4:
                assert out.columns == docs.columns
                assert out.count() <= (now.count() if i < 3 else 3 * now.count())
                now = spark.createDataFrame(out.collect(), out.schema)
            else:
                assert (out.count() > 0) == (given is docs)
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sum(r.doc_id == 7 and r.text == text(51) for r in kept) <= 1
