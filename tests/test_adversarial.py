"""Rules against Python's own ``re``, ``unicodedata`` and ``urllib`` on look-alike characters."""

import re
import unicodedata
from urllib.parse import urlparse

from pyspark.sql import functions as F

from mailrisk import constants as K
from mailrisk.functions import signals as L
from mailrisk.functions import urls as U

FOLDS = [c for c in map(chr, range(0x80, 0x110000)) if any(re.fullmatch(a, c, re.I) for a in "abcdefghijklmnopqrstuvwxyz")]
FORMS = [c for c in map(chr, range(0x80, 0x110000)) if any(d in "/?#@:" for d in unicodedata.normalize("NFKC", c))]


def python_words(words):
    return re.compile(r"\b(?:" + "|".join(words) + r")\b", re.I)


def test_keywords_with_every_folding_character(spark):
    assert FOLDS
    rules = [(K.URGENT_WORDS, 1), (K.CREDENTIAL_WORDS, 2), (K.FINANCIAL_WORDS, 4), (K.PRIZE_WORDS, 5), (K.PROMO_WORDS, 6), (K.CTA_WORDS, 7)]
    plain = [w for words, _ in rules for w in words if re.fullmatch(r"[a-z ]+", w)]
    texts = [f"x {w[:i]}{c}{w[i + 1:]} y" for w in plain for i, ch in enumerate(w) for c in FOLDS if re.fullmatch(ch, c, re.I)]
    assert len(texts) > 50
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower("t").alias("low"))
    flags = L.rule_flags("low", "t")
    got = df.select("t", *[flags[f"L{n}"].alias(f"L{n}") for _, n in rules]).collect()
    for r in got:
        for words, n in rules:
            assert r[f"L{n}"] == bool(python_words(words).search(r["t"].lower())), (n, r["t"])


def python_error(u):
    try:
        urlparse(u)
    except ValueError as e:
        return str(e)


def test_url_validity_for_every_delimiter_form(spark):
    assert len(FORMS) >= 15
    urls = [u for c in FORMS for u in (f"https://example.com{c}", f"https://exa{c}mple.com/x", f"https://ok.com/a{c}b", f"http://u{c}@h.com", f"https://h.com?q={c}")]
    urls += ["https://[::1/x", "https://a]b.com", "https://ok.com", "https://\u00e9t\u00e9.com/", "http\u017f://b.com\uff1f"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    for r in df.select("u", U.parse_error("u").alias("e"), U.host("u").alias("h"), U.is_https("u").alias("s")).collect():
        assert r.e == python_error(r.u), r.u
        if r.e is None:
            p = urlparse(r.u)
            assert (r.h or "") == (p.hostname or "") and r.s == (p.scheme == "https"), r.u


def test_long_s_in_the_scheme_is_found(spark):
    text = "see http\u017f://a.example.com/x and HTTPS://b.example.com, ok"
    want = re.findall(r"https?://[^\s<>\"']+", text, re.I)
    got = spark.createDataFrame([("", text)], "s string, b string").select(U.extract_urls("s", "b").alias("u")).first().u
    assert got == [u.rstrip(K.URL_TRAILING_STRIP) for u in want]
