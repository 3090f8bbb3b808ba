import pytest
from pyspark.sql import functions as F

from mailrisk.functions import text as TX
from mailrisk.operators import corpus as C


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_clean_text_strips_python_whitespace(spark):
    assert one_col(spark, [None, " a\t", "\x1fa", "  ", " b　"], TX.clean) == ["", "a", "a", "", "b"]


def test_normalize_label_spellings(spark):
    got = one_col(spark, [" Spam ", "1.0", "0", "2", "maybe", "", None, "Not Spam", "TRUE", "0.0", "1d"],
                  TX.normalize_label)
    assert got == [1, 1, 0, None, None, None, None, 0, 1, 0, None]


def test_combine_text_strips_end(spark):
    df = spark.createDataFrame([("s", "b"), ("s", ""), ("", "")], "subject string, body string")
    assert [r[0] for r in df.select(TX.combine_text("subject", "body")).collect()] == \
        ["Subject: s\n\nb", "Subject: s", "Subject:"]


def test_pick_col_exact_then_substring():
    assert C.pick_col(["Title", "E-mail Text", "is_spam"], ["subject", "title"]) == "Title"
    assert C.pick_col(["Title", "E-mail Text", "is_spam"], ["body", "email", "text", "message", "content"]) \
        == "E-mail Text"
    assert C.pick_col(["Title", "E-mail Text", "is_spam"], ["label", "spam", "class", "target", "is_spam"]) \
        == "is_spam"
    # greedy second pass: any column containing 'to' is a recipient
    assert C.pick_col(["text", "customer_id"], ["recipient", "receiver", "to", "to_email"]) == "customer_id"


def test_canonicalize_requires_body(spark):
    df = spark.createDataFrame([(0, "x")], "_row_order long, title string")
    with pytest.raises(ValueError):
        C.canonicalize(df)


def test_canonicalize_layout(spark):
    df = spark.createDataFrame([(0, " Hi ", "Body ", "spam")], "_row_order long, Title string, `E-mail Text` string, is_spam string")
    r = C.canonicalize(df).collect()[0]
    assert (r.subject, r.body, r.label, r.sender, r.urls) == ("Hi", "Body", 1, "", "")


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("Café au Lait x y_z",)], "t string")
    toks = df.select(TX.ngrams_1_2(TX.word_tokens(TX.fold_case_accents(F.col("t"))))).first()[0]
    assert toks == ["cafe", "au", "lait", "y_z", "cafe au", "au lait", "lait y_z"]


def test_fold_matches_python_fold(spark):
    import unicodedata

    def py_fold(s):  # lower-case, NFKD, drop combining marks
        return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))

    samples = ["Café au LAIT", "İstanbul", "ĳssel Ĳ", "ǅemal ǄǆǅǇ", "Straße ß", "naïve Ñandú", "½ price ¼",
               "ﬁne ﬂow", "Ωmega ΆΈ", "école", "Brand™", "ſtop", "Ærø Œuvre", "plain ascii", "ÀÉÎÕÜ ąęłńśźż",
               "Ŀl·l ŀ", "ǰ ǱǲǳǊ", "Привет Ёж", "数字１２３"]
    got = one_col(spark, samples, TX.fold_case_accents)
    assert got == [py_fold(s) for s in samples]
