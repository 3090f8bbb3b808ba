from pyspark.sql import functions as F

from conftest import SF_MID
from mailrisk.operators import training as T
from mailrisk.plans import catalog as CAT


def test_split_shares_exact_and_partition_independent(spark):
    docs = CAT.training_docs(spark, SF_MID)
    counts = {(r.label, r.is_test): r.n for r in T.split_counts(T.stratified_split(docs)).collect()}
    for label in (0, 1):
        n = counts[(label, True)] + counts[(label, False)]
        assert counts[(label, True)] == int(0.2 * n + 0.5)
    a = sorted(r.doc for r in T.stratified_split(docs).filter("is_test").select("doc").collect())
    b = sorted(r.doc for r in T.stratified_split(docs.repartition(7)).filter("is_test").select("doc").collect())
    assert a == b


def test_metrics_undefined_cases(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, pred int")
    r = T.classification_metrics(df).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.5, 0.0, 0.0, 0.0)
    df = spark.createDataFrame([(0, 1), (0, 0)], "label int, pred int")
    r = T.classification_metrics(df).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_fit_separates_training_labels(spark):
    docs = CAT.training_docs(spark, SF_MID)
    terms, intercept, n = T.fit_spam_model(docs, id_col="doc", max_iter=30)
    assert n == docs.count() and terms.count() > 0
    from mailrisk.operators import text_model as M
    scored = M.score(docs.select("doc", "label", "text"), terms, intercept)
    pred = scored.withColumn("pred", (F.col("spam_risk") >= 50).cast("int"))
    assert T.classification_metrics(pred).first().accuracy > 0.6


def test_retrain_paths_checks_inputs_first(spark, tmp_path):
    import pytest
    from mailrisk.plans import retrain as RT
    ok = tmp_path / "ok.csv"
    ok.write_text("subject,body,label\nhi,there,spam\n")
    with pytest.raises(FileNotFoundError):
        RT.retrain_paths(spark, str(ok), [str(tmp_path / "missing.csv")], str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_retrain_paths_end_to_end(spark, tmp_path):
    from mailrisk import fixtures as FX
    from mailrisk.plans import retrain as RT
    from mailrisk.sources import corpus_io as CIO
    from conftest import SF_SMALL
    src = str(tmp_path / "emails.csv.gz")
    CIO.write_csv(FX.emails(spark, SF_SMALL).orderBy("row_idx").drop("row_idx"), src)
    extra = str(tmp_path / "extra.csv")
    with open(extra, "w") as f:
        f.write("title,text,is_spam\nwin a prize now,claim your prize today,yes\nlunch,see you at noon,no\n")
    report, terms, _ = RT.retrain_paths(spark, src, [extra], str(tmp_path / "out"), max_iter=20)
    got = {r.metric: r.value for r in report.collect()}
    assert got["raw_counts.extra.csv"] == 2.0 and got["raw_counts.canonical"] == 200.0
    assert 0.0 <= got["metrics.accuracy"] <= 1.0 and terms.count() > 0


def test_term_statistics_are_not_counted_inside_the_row(spark):
    """A term's first place in a text is seen from the one before it, without an array filter over the text's terms."""
    from mailrisk.operators import text_model as M
    docs = spark.createDataFrame([(1, "The cat, the CAT sat"), (2, None), (3, "é"), (4, "cat cat Café sat cat"), (5, "")], "doc long, text string")
    found = M.term_statistics(docs)
    assert "filter(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.term: (r.df, r.cf) for r in found.collect()} == {
        "cat": (2, 5), "the": (1, 2), "sat": (2, 2), "the cat": (1, 2), "cat the": (1, 1), "cat sat": (1, 1),
        "cat cat": (1, 1), "cat cafe": (1, 1), "cafe": (1, 1), "cafe sat": (1, 1), "sat cat": (1, 1)}
