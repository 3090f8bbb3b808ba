from pyspark.sql import functions as F

from mailrisk import constants as K
from mailrisk.functions import sender as D
from mailrisk.functions import urls as U
from mailrisk.functions import risk as RK
from mailrisk.operators import rules as R


def emails(spark, rows):
    data = [(i, s, b, snd) for i, (s, b, snd) in enumerate(rows)]
    return spark.createDataFrame(data, "row_idx long, subject string, body string, sender string")


def signals_of(spark, rows):
    df = R.with_signals(emails(spark, rows)).orderBy("row_idx")
    return [r.signals for r in df.select("signals").collect()]


def test_url_extraction_order_trailing_and_dedup(spark):
    df = R.with_urls(emails(spark, [("", "see https://ok.example.com/a). then https://ok.example.com/a, "
                                         "HTTP://X.org/p;", "")]))
    assert df.first().url_list == ["https://ok.example.com/a", "HTTP://X.org/p"]


def test_first_url_finding_stops_at_first(spark):
    cases = [
        ("https://ok.example.com http://x", K.REASON_URL_HTTP),
        ("https://1.2.3.4/a", K.REASON_URL_IP),
        ("https://a_b.com/login", K.REASON_URL_SENSITIVE),
        ("https://[::1", K.REASON_URL_INVALID),
        ("http://[::1]", K.REASON_URL_INVALID),   # the trailing ']' strip unbalances it
        ("https://ok.example.com/x https://1.2.3.4", K.REASON_URL_IP),
        ("https://ok.example.com", None),
    ]
    df = R.with_urls(emails(spark, [("", b, "") for b, _ in cases])).orderBy("row_idx")
    got = [r[0] for r in df.select(U.first_finding("url_list")).collect()]
    assert got == [e for _, e in cases]


def test_suspicious_count_word_bound_vs_substring(spark):
    df = R.with_urls(emails(spark, [("", "https://x/accounts", ""), ("", "https://x/account", ""),
                                    ("", "http://x/", "")])).orderBy("row_idx")
    got = df.select(U.suspicious_count("url_list"), U.first_finding("url_list")).collect()
    assert [(r[0], r[1]) for r in got] == [(0, K.REASON_URL_SENSITIVE), (1, K.REASON_URL_SENSITIVE),
                                           (1, K.REASON_URL_HTTP)]


def test_host_and_https(spark):
    df = spark.createDataFrame([("https://User@Evil.Example.COM:8080/x",), ("http://[::1]:80/",)], "u string")
    got = df.select(U.host("u"), U.is_https("u")).collect()
    assert [(r[0], r[1]) for r in got] == [("evil.example.com", True), ("::1", False)]


def test_capitals_thresholds(spark):
    nineteen = "A" * 19
    twenty_low = "A" * 7 + "a" * 13      # share exactly 0.35 -> no
    twenty_hi = "A" * 8 + "a" * 12       # 0.40 -> yes
    got = signals_of(spark, [("", nineteen, ""), ("", twenty_low, ""), ("", twenty_hi, "")])
    assert [K.REASON_CAPITALS in s for s in got] == [False, False, True]


def test_language_rules_word_bounds_and_lines(spark):
    got = signals_of(spark, [
        ("", "please verify your account", ""),
        ("", "please verify\nyour account", ""),   # '.' does not cross the newline
        ("", "verifyaccount", ""),
        ("", "éurgent matter", ""),                 # a letter touches the keyword
        ("", "urgent: act now", ""),
        ("", "wow!! really?? ok", ""),
    ])
    assert got[0] == [K.REASON_VERIFICATION]
    assert got[1] == []
    assert got[2] == []
    assert got[3] == []
    assert got[4] == [K.REASON_URGENT]
    assert got[5] == [K.REASON_PUNCTUATION]


def test_signal_order(spark):
    got = signals_of(spark, [("URGENT prize", "click here http://x.org gift card!! ??", "")])[0]
    assert got == [K.REASON_URGENT, K.REASON_PRIZE, K.REASON_CTA, "1" + K.REASON_URL_COUNT_SUFFIX,
                   K.REASON_URL_HTTP, K.REASON_PUNCTUATION, K.REASON_SOCIAL]


def test_sender_analysis_cases(spark):
    cases = ["", "bob", "a@b@c.com", "abc@", "x@9.com", "no-reply@verify.io"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string").orderBy("i")
    got = df.select(D.analysis("s", F.lit("HAM"), F.lit(0)).alias("a")).collect()
    a = [r.a for r in got]
    assert (a[0].score, a[0].indicators, a[0].verification) == (0.0, None, K.SENDER_VERIFICATION_EMPTY)
    assert (a[1].score, a[1].domain, a[1].indicators) == (60.0, "", [K.SENDER_NO_AT])
    assert (a[2].domain, a[2].score) == ("c.com", 45.0)          # last '@' for the domain, shape fails
    assert (a[3].domain, a[3].score) == ("", 45.0)               # '@' but empty domain: no domain checks
    assert a[4].score == 35.0 and a[4].indicators == [K.SENDER_DOMAIN_SHAPE]
    assert a[5].score == 35.0 and a[5].indicators == [K.SENDER_ROLE, K.SENDER_SENSITIVE]


def test_sender_context_addon(spark):
    df = spark.createDataFrame([("x@9.com",)], "s string")
    r = df.select(D.score("s", F.lit("SPAM"), F.lit(10)).alias("a"), D.score("s", F.lit("SPAM"), F.lit(2)).alias("b")).first()
    assert (r.a, r.b) == (60.0, 43.0)


def test_risk_levels_and_prediction(spark):
    vals = [34.9, 35.0, 64.9, 65.0, 84.9, 85.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(RK.risk_level("x")).collect()] == \
        ["LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    df = spark.createDataFrame([(49.99,), (50.0,)], "x double")
    assert [r[0] for r in df.select(RK.prediction("x")).collect()] == ["HAM", "SPAM"]
