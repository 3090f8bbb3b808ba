"""URL column expressions (U1-U7).  All JVM-side, no shuffle."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .regex import IPV4_HOST, URL_PATTERN, java_words
from .text import _c


def extract_urls(subject, body) -> Column:
    """Distinct urls of ``subject \\n body`` in first-seen order, trailing ``.,);]`` removed."""
    text = F.concat(_c(subject), F.lit("\n"), _c(body))
    found = F.regexp_extract_all(F.when(text.isNull() | text.contains("://"), text).otherwise(F.lit("")), F.lit(URL_PATTERN), 0)
    return F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(K.URL_TRAILING_STRIP))))


def authority(u) -> Column:
    """Text between ``//`` and the path; empty where the scheme is not plain ASCII."""
    return F.regexp_extract(_c(u), r"(?i)^https?://([^/?#]*)", 1)


# Characters beyond ASCII whose NFKC form holds one of the URL delimiters (full-width forms and the like).
DELIMITER_FORMS = "".join(c for c in map(chr, range(0x80, 0x110000))
                          if any(d in "/?#@:" for d in unicodedata.normalize("NFKC", c)))
DELIMITER_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in DELIMITER_FORMS) + "]"


def parse_error(u) -> Column:
    """Why a url cannot be parsed, or NULL: '[' without ']' (or the reverse) in
    the authority, or a character there that normalises to a delimiter."""
    a = authority(u)
    return (F.when(a.contains("[") != a.contains("]"), F.lit(K.URL_ERROR_BRACKETS))
            .when(a.rlike(DELIMITER_CLASS), F.concat(F.lit("netloc '"), a, F.lit(K.URL_ERROR_NFKC_SUFFIX))))


def is_invalid(u) -> Column:
    return parse_error(u).isNotNull()


def host(u) -> Column:
    """Host: after the last '@', bracket contents or text before the first ':', lower-cased
    (an IPv6 zone after '%' keeps its case)."""
    info = F.substring_index(authority(u), "@", -1)
    bracketed = F.substring_index(F.substr(info, F.instr(info, "[") + 1), "]", 1)
    h = F.when(info.contains("["), bracketed).otherwise(F.substring_index(info, ":", 1))
    pct = F.instr(h, "%")
    return F.when(pct > 0, F.concat(F.lower(F.substring_index(h, "%", 1)), F.substr(h, pct)))\
        .otherwise(F.lower(h))


def is_https(u) -> Column:
    return F.lower(F.substring_index(_c(u), ":", 1)) == "https"


def finding(u) -> Column:
    """Per-url finding in check order; NULL when the url is clean."""
    low = F.lower(_c(u))
    sensitive = _c(u).contains("@")
    for w in K.URL_SENSITIVE_SUBSTRINGS:
        sensitive = sensitive | low.contains(w)
    return (F.when(is_invalid(u), F.lit(K.REASON_URL_INVALID))
            .when(~is_https(u), F.lit(K.REASON_URL_HTTP))
            .when(host(u).rlike(IPV4_HOST), F.lit(K.REASON_URL_IP))
            .when(sensitive, F.lit(K.REASON_URL_SENSITIVE)))


def first_finding(urls) -> Column:
    """U4: the finding of the first url that has one (the scan stops there)."""
    return F.get(F.filter(F.transform(_c(urls), finding), lambda x: x.isNotNull()), 0)


def count_signal(urls) -> Column:
    """``"{n} external URL(s) detected"`` when there is at least one url."""
    n = F.size(_c(urls))
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(K.REASON_URL_COUNT_SUFFIX)))


_SUSPICIOUS = java_words(K.URL_SENSITIVE_SUBSTRINGS, ignore_case=True)


def suspicious_count(urls) -> Column:
    """Urls with '@', a whole-word sensitive keyword, or not starting with https://."""
    return F.size(F.filter(_c(urls), lambda u: u.contains("@") | u.rlike(_SUSPICIOUS)
                           | ~F.lower(u).startswith("https://")))


def suspicious_share(suspicious, detected) -> Column:
    """min(100, suspicious / detected * 100), 0 when nothing is suspicious."""
    s, d = _c(suspicious), _c(detected)
    return F.when(s > 0, F.least(F.lit(100.0), s / d * 100.0)).otherwise(F.lit(0.0))


def url_risk(urls) -> Column:
    """min(100, 25 x number of distinct urls)."""
    return F.least(F.lit(100), F.size(_c(urls)) * K.URL_RISK_PER_URL)


def first_error(urls) -> Column:
    """The parse error of the first url that has one, else NULL."""
    return F.get(F.filter(F.transform(_c(urls), parse_error), lambda x: x.isNotNull()), 0)


def items(urls) -> Column:
    """U2 as an array: url, host ('' when none) and https flag per url."""
    return F.transform(_c(urls), lambda u: F.struct(
        u.alias("url"), F.coalesce(host(u), F.lit("")).alias("domain"), is_https(u).alias("https")))
