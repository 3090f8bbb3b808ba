import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailrisk.llm import language, quality, toxicity
from mailrisk.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, TEXT string"


def auc(rows):
    """Share of (positive, negative) pairs in the right order."""
    ones, zeros = [s for s, y in rows if y], [s for s, y in rows if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in language.op2_language(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert {r.doc_id for r in held} == {k for k, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in got.values()]) < 0.02
    assert all(0 <= r.score <= 1 for r in got.values())


def sample_docs(spark):
    english, german = "the cat and the dog went home ", "der Hund und die Katze gehen heim "
    rows = [(i, (english, german)[i % 2] * (1 + i % 5), ("en", "de")[i % 2], "s", "x") for i in range(60)]
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, "123 !? 。", "en", None, None), (103, "the", None, None, None),
             (104, english * 60_000, None, None, None), (None, german, None, None, None), (1, german, "de", "s", "x"), (1, german, "de", "s", "x")]
    return rows, spark.createDataFrame(rows, DOCS)


def test_language_edges(spark):
    rows, docs = sample_docs(spark)
    got = language.op2_language(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score, by[i].rejected) for i in (100, 101, 102)] == [("und", 0.0, True)] * 3
    assert by[104].lang_pred == by[103].lang_pred == "en" and by[None].lang_pred == "de" and by[None].held_out is False
    kept = language.keep_recognised(docs)
    assert kept.columns == docs.columns
    assert not {100, 101, 102} & {r[0] for r in kept.collect()}
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.op2_language(unknown).collect()} == {"und"}
    one = docs.filter("lang = 'en'")
    assert {r.lang_pred for r in language.op2_language(one).filter("doc_id < 100").collect()} == {"en"}
    assert language.op2_language(docs.limit(0)).collect() == []


def test_subwords_do_not_cross_texts():
    texts = [b"ab", b"", b"c d", b"x" * 9]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    bucket, doc = language.subwords(buf, off)
    for i, t in enumerate(texts):
        alone, _ = language.subwords(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert sorted(bucket[doc == i].tolist()) == sorted(alone.tolist())


@pytest.mark.parametrize("module,operator,column,least", [
    (toxicity, toxicity.op9_toxicity, "toxic", 0.9), (quality, quality.op10_quality, "quality", 0.97)])
def test_held_out_order(spark, module, operator, column, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in operator(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].score, r[column]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels.collect())
    assert auc(held) > least


@pytest.mark.parametrize("operator,none", [(toxicity.op9_toxicity, 0), (quality.op10_quality, 1)])
def test_label_edges(spark, operator, none):
    rows, docs = sample_docs(spark)
    schema = "doc_id long, quality int, toxic int, Doc_ID string"
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 > 0), "x") for i in range(60)] + [(1, 1, 1, "x"), (2, None, None, "x"), (999, 1, 0, "x"), (None, 1, 1, "x")], schema)
    got = operator(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    nothing = operator(docs, spark.createDataFrame([], schema)).collect()
    assert len(nothing) == len(rows) and {r.predicted for r in nothing} == {none}
    ones = operator(docs, labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(1))).collect()
    assert {r.predicted for r in ones} == {1}
    assert operator(docs.limit(0), labels).collect() == []


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    rows = [(int(i % 4 == 0), np.unique(np.append(rng.integers(10, 1 << 18, 80), [3] if i % 4 == 0 else [5]))) for i in range(800)]
    ids, w, bias = toxicity.ftrl(rows)
    weight = dict(zip(ids.tolist(), w.tolist(), strict=True))
    assert weight[3] > 0 and len(ids) < 2000
    right = [(sum(weight.get(int(x), 0) for x in f) + bias > 0) == bool(y) for y, f in rows]
    assert np.mean(right) > 0.99


def test_log_odds_are_gaussian_densities():
    rng = np.random.default_rng(0)
    k = len(quality.NAMES)
    model = {"means": {}, "factors": {}, "offsets": {}}
    cov = {}
    for y in (0, 1):
        a = rng.standard_normal((k, k))
        cov[y] = a @ a.T + np.eye(k)
        low = np.linalg.cholesky(cov[y])
        model["means"][y], model["factors"][y], model["offsets"][y] = rng.standard_normal(k), np.linalg.inv(low), -np.log(np.diag(low)).sum()
    x = rng.standard_normal((5, k))
    dense = {y: [-0.5 * (np.linalg.slogdet(cov[y])[1] + (v - model["means"][y]) @ np.linalg.solve(cov[y], v - model["means"][y])) for v in x] for y in (0, 1)}
    assert np.allclose(quality.log_odds(x, model), np.array(dense[1]) - dense[0])


def test_rejecting_stage_keeps_columns(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert len(left & bad) <= 0.1 * len(bad) and len(left & good) >= 0.97 * len(good)


def test_the_toxicity_sample_holds_one_text_an_id(spark, monkeypatch):
    """A sampled doc_id that stands thousands of times in the table does not reach the driver that often."""
    docs = spark.createDataFrame([(i, f"good {i} words" if i % 2 else f"bad {i} insult") for i in range(1, 21)] + [(3, f"again {i}") for i in range(3000)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(1, 21)], "doc_id long, label int")
    seen = []
    whole = toxicity.ftrl
    monkeypatch.setattr(toxicity, "ftrl", lambda rows, *a: seen.append(len(rows)) or whole(rows, *a))
    toxicity.fit(docs, labels, per_class=10)
    assert seen and max(seen) <= 20
