import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from mailrisk.llm.common import stored, table
from mailrisk.llm.tokens import Encoder

from .test_decontaminate import brute as hits
from .test_near import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_inputs(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()} if name != "packing" else before
        docs = stored(stage(spark, docs, SF), "test-stage")
        outs[name] = docs
        if name != "packing":
            assert docs.columns == names
            left = {r.doc_id: r for r in docs.collect()}
            assert all(left[i] == before[i] for i in left)
        if name == "quality":
            wrong = [i for i, q in labels.items() if i in before and (i in left) != bool(q)]
            assert len(wrong) <= 0.1 * len(labels)
        elif name == "language":
            assert len(left) >= 0.97 * len(before) and all(re.search(r"[^\W\d_]", r.text) for r in left.values())
        elif name == "near-dedup":
            want = groups([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(left) == {i for i, c in want.items() if i == c}
        elif name == "decontaminate":
            clean = {h[0] for h in hits([(i, r.text) for i, r in before.items()], items) if not h[5]}
            assert set(left) == clean
            before = left
    tok = Encoder(public_tokenizers.path("word_bpe_49k.json")).tok
    sizes = {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in left.items()}
    packed = outs["packing"].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == sizes


def test_run_is_the_stages_in_order(spark):
    run = corpus_pipeline.run(spark, SF)
    assert run.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert run.count() > 0


def test_empty_documents_pass_through(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.count() == 0, name
