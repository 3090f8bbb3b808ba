import math

from pyspark.sql import functions as F

from conftest import SF_SMALL
from mailrisk import fixtures as FX
from mailrisk.operators import analyze as A
from mailrisk.operators import text_model as M


def ruled(spark):
    return A.rule_table(FX.emails(spark, SF_SMALL)).select("row_idx", "text")


def test_tfidf_norms_are_one(spark):
    w = M.tfidf(ruled(spark), FX.model_terms(spark))
    norms = w.groupBy("row_idx").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert norms and all(abs(r.n - 1.0) < 1e-9 for r in norms)


def test_scores_by_intercept_without_terms(spark):
    df = spark.createDataFrame([(1, "Subject: nothing here")], "row_idx long, text string")
    r = M.score(df, FX.model_terms(spark), FX.MODEL_INTERCEPT).first()
    assert abs(r.spam_risk - 100 / (1 + math.exp(0.5))) < 1e-9


def test_explanations_have_predicted_sign(spark):
    docs = ruled(spark)
    model = FX.model_terms(spark)
    out = M.explain_terms(M.predict(M.score(docs, model, FX.MODEL_INTERCEPT)))
    coef = {t: c for t, _, c in FX.MODEL_TERMS}
    n = 0
    for r in out.collect():
        assert len(r.model_terms) <= 5
        for t in r.model_terms:
            assert len(t) >= 3
            assert (coef[t] > 0) == (r.prediction == "SPAM")
            n += 1
    assert n > 0


def test_explanations_partition_independent(spark):
    docs = ruled(spark)
    model = FX.model_terms(spark)

    def run(d):
        return sorted((r.row_idx, tuple(r.spam_terms), tuple(r.ham_terms))
                      for r in M.score(d, model, FX.MODEL_INTERCEPT).collect())
    assert run(docs) == run(docs.repartition(1)) == run(docs.repartition(7))


def test_analysis_error_path_is_per_row(spark):
    df = spark.createDataFrame([(0, "a@b.com", "x", "hi", "see https://[::1/x"),
                                (1, "a@b.com", "x", "hi", "meeting agenda")],
                               "row_idx long, sender string, recipient string, subject string, body string")
    out = {r.row_idx: r for r in A.analyze_emails(df, FX.model_terms(spark), FX.MODEL_INTERCEPT).collect()}
    assert out[0].error is not None and out[0].prediction is None
    assert out[1].error is None and out[1].prediction == "HAM" and out[1].domain_category == "Work"


def test_rows_that_share_or_lack_an_id_are_scored_alone(spark):
    texts = ["meeting agenda family dinner", "verify your account login password", "nothing", "click here to verify your account"]
    schema = "row_idx long, sender string, recipient string, subject string, body string"
    rows = [(i, "a@b.com", "x", "hi", t) for i, t in enumerate(texts)]
    alone = {r[4]: A.flatten(A.analyze_emails(spark.createDataFrame([r], schema), FX.model_terms(spark), FX.MODEL_INTERCEPT)).first() for r in rows}
    for ids in ([0, 0, 0, 0], [None, None, 7, 7]):
        df = spark.createDataFrame([(i, *r[1:]) for i, r in zip(ids, rows)], schema)
        got = A.analyze_emails(df.withColumn("raw", F.col("body")), FX.model_terms(spark), FX.MODEL_INTERCEPT, keep=("raw",)).collect()
        assert len(got) == 4
        for r in got:
            assert (r.spam_risk, r.prediction) == (alone[r.raw].spam_risk, alone[r.raw].prediction)


def test_terms_are_counted_like_a_counter(spark):
    from collections import Counter
    texts = ["a bb bb a-bb cc", "", "one one one", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string")
    import re
    for i, t in enumerate(texts):
        w = re.findall(r"\w{2,}", t)
        want = Counter(w) + Counter(f"{x} {y}" for x, y in zip(w, w[1:]))
        assert {r.term: r.tf for r in M.doc_terms(df).filter(F.col("row_idx") == i).collect()} == dict(want)


def test_both_forms_of_scoring_agree(spark):
    """Row by row, with null, empty and repeated texts, rows of one id, a model with odd terms, and an empty model."""
    rows = [(1, "Verify your account, verify now! click here"), (2, None), (3, ""), (4, "the meeting agenda is family dinner verify"),
            (4, "zzz"), (None, "Éclair VERIFY " * 500), (4, "zzz"), (5, 'quote " and \\ back verify')]
    df = spark.createDataFrame(rows, "id int, text string")
    odd = [('a "b\\', 1.0, 2.0), ("\u2028x", 1.5, -2.0), ("eclair", 3.25, -0.1), ("eclair verify", 0.1 + 0.2, 1e-17)]
    odd += [(f"word{i}", 1.0 + i / 7, (-1) ** i * i / 3) for i in range(3000)]
    model = FX.model_terms(spark).unionByName(spark.createDataFrame(odd, FX.MODEL_SCHEMA))
    for m in (model, model.limit(0)):
        out = []
        for form in (M.score, M.score_by_join):
            got = [r.asDict() for r in form(df, m, -0.5).collect()]
            out.append(sorted([(str(r["id"]), round(r["margin"], 9), r["spam_terms"], r["ham_terms"]) for r in got]))
        assert out[0] == out[1] and len(out[0]) == len(rows)
