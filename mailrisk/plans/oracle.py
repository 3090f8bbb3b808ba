"""DuckDB (RE2) dialect of the engine's rules, for the correctness oracle.

The oracle SQL must compute the same thing independently of the Spark code
path, so these helpers only spell the fixed rules in DuckDB SQL; the keyword
lists and thresholds come from ``constants`` like the Spark side.
"""

from __future__ import annotations

from .. import constants as K
from ..fixtures import EMAILS_SQL
from ..functions.urls import DELIMITER_CLASS
from ..functions.regex import (PUNCT_RUNS, PY_WHITESPACE, WS_CLASS, re2_verification, re2_words,
                               sql_str)

WS_SQL = "(" + "||".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"


def clean(x: str) -> str:
    return f"coalesce(trim(CAST({x} AS VARCHAR), {WS_SQL}), '')"


def in_list(values) -> str:
    return "(" + ", ".join(sql_str(v) for v in values) + ")"


def label_norm(x: str) -> str:
    s = f"lower(trim(CAST({x} AS VARCHAR), {WS_SQL}))"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} IN {in_list(K.SPAM_SPELLINGS)} THEN 1 "
            f"WHEN {s} IN {in_list(K.HAM_SPELLINGS)} THEN 0 "
            f"WHEN try_cast({s} AS DOUBLE) = 1 THEN 1 WHEN try_cast({s} AS DOUBLE) = 0 THEN 0 END")


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {sql_str(pattern)})"


CANON = f"""canon AS (
 SELECT row_idx, 0 AS src_ord, 'canonical' AS source,
  {clean('subject')} AS subject, {clean('body')} AS body, {clean('sender')} AS sender,
  {clean('recipient')} AS recipient, '' AS urls, CAST(label_raw AS VARCHAR) AS label_raw,
  {label_norm('label_raw')} AS label
 FROM emails)"""

CORPUS = """corpus AS (
 SELECT row_number() OVER (ORDER BY src_ord, row_idx) - 1 AS row_idx, source, subject, body, sender,
  recipient, urls, label
 FROM (SELECT *, row_number() OVER (PARTITION BY subject, body ORDER BY src_ord, row_idx) AS rn
       FROM canon WHERE length(subject) + length(body) > 0) t WHERE rn = 1)"""

TRAINING = """training AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, body ORDER BY src_ord, row_idx) AS rn
       FROM canon WHERE label IS NOT NULL AND label IN (0, 1) AND length(subject) + length(body) > 0) t
 WHERE rn = 1)"""


def with_ctes(*ctes: str) -> str:
    return "WITH emails AS (" + EMAILS_SQL + "),\n" + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# Rules in RE2
# ---------------------------------------------------------------------------

URL_RE2 = "(?i)https?://[^" + WS_CLASS + "<>\"']+"
TRAIL_SQL = sql_str(K.URL_TRAILING_STRIP)


def urls_expr(subject: str, body: str) -> str:
    """list_distinct does not keep order in DuckDB, so dedup by first position."""
    found = f"regexp_extract_all({subject} || chr(10) || {body}, {sql_str(URL_RE2)})"
    trimmed = f"list_transform({found}, lambda u: rtrim(u, {TRAIL_SQL}))"
    return (f"list_filter({trimmed}, lambda u, i: list_position({trimmed}, u) = i)")


def authority(u: str) -> str:
    return f"regexp_extract({u}, '^(?:[Hh][Tt][Tt][Pp][Ss]?)://([^/?#]*)', 1)"


def url_error(u: str) -> str:
    a = authority(u)
    return (f"CASE WHEN contains({a}, '[') <> contains({a}, ']') THEN {sql_str(K.URL_ERROR_BRACKETS)} "
            f"WHEN regexp_matches({a}, '{DELIMITER_CLASS}') THEN 'netloc ' || chr(39) || {a} || {sql_str(K.URL_ERROR_NFKC_SUFFIX)} END")


def invalid(u: str) -> str:
    return f"({url_error(u)} IS NOT NULL)"


def folded(x: str) -> str:
    """RE2 folds the long s but not the dotless i onto ASCII letters."""
    return f"translate({x}, chr(305) || chr(383), 'is')"


def host(u: str) -> str:
    info = f"regexp_extract({authority(u)}, '([^@]*)$', 1)"
    h = (f"(CASE WHEN contains({info}, '[') THEN split_part(substr({info}, strpos({info}, '[') + 1), ']', 1) "
         f"ELSE split_part({info}, ':', 1) END)")
    return (f"(CASE WHEN strpos({h}, '%') > 0 THEN lower(split_part({h}, '%', 1)) || substr({h}, strpos({h}, '%')) "
            f"ELSE lower({h}) END)")


def is_https(u: str) -> str:
    return f"(lower(split_part({u}, ':', 1)) = 'https')"


def finding(u: str) -> str:
    sens = " OR ".join([f"contains({u}, '@')"] + [f"contains(lower({u}), '{w}')" for w in K.URL_SENSITIVE_SUBSTRINGS])
    return (f"CASE WHEN {invalid(u)} THEN {sql_str(K.REASON_URL_INVALID)} "
            f"WHEN NOT {is_https(u)} THEN {sql_str(K.REASON_URL_HTTP)} "
            f"WHEN regexp_matches({host(u)}, '^\\p{{Nd}}{{1,3}}(\\.\\p{{Nd}}{{1,3}}){{3}}$') THEN {sql_str(K.REASON_URL_IP)} "
            f"WHEN {sens} THEN {sql_str(K.REASON_URL_SENSITIVE)} END")


def first_finding(urls: str) -> str:
    return f"list_filter(list_transform({urls}, lambda u: {finding('u')}), lambda x: x IS NOT NULL)[1]"


def suspicious_count(urls: str) -> str:
    pat = sql_str(re2_words(K.URL_SENSITIVE_SUBSTRINGS))
    return (f"len(list_filter({urls}, lambda u: contains(u, '@') OR regexp_matches({folded('u')}, {pat}) "
            f"OR NOT starts_with(lower(u), 'https://')))")


LANGUAGE_RE2 = [
    (K.REASON_URGENT, re2_words(K.URGENT_WORDS)),
    (K.REASON_CREDENTIALS, re2_words(K.CREDENTIAL_WORDS)),
    (K.REASON_VERIFICATION, re2_verification()),
    (K.REASON_FINANCIAL, re2_words(K.FINANCIAL_WORDS)),
    (K.REASON_PRIZE, re2_words(K.PRIZE_WORDS)),
    (K.REASON_PROMO, re2_words(K.PROMO_WORDS)),
    (K.REASON_CTA, re2_words(K.CTA_WORDS)),
]


def capitals(t: str) -> str:
    letters = f"length(regexp_replace({t}, '\\P{{L}}', '', 'g'))"
    upper = f"length(regexp_replace({t}, '\\P{{Lu}}', '', 'g'))"
    return f"({letters} >= {K.CAPITALS_MIN_LETTERS} AND {upper} * 100 > {letters} * {int(K.CAPITALS_SHARE * 100)})"


def punctuation(t: str) -> str:
    return f"(len(regexp_extract_all({t}, {sql_str(PUNCT_RUNS)})) >= {K.PUNCTUATION_MIN_RUNS})"


def flags(subject: str, body: str) -> dict:
    low = f"lower({subject} || chr(10) || {body})"
    orig = f"({subject} || chr(10) || {body})"
    out = {f"L{i + 1}": rx(folded(low), p) for i, (_, p) in enumerate(LANGUAGE_RE2)}
    out["L8"] = capitals(orig)
    out["L9"] = punctuation(orig)
    out["L10"] = rx(low, re2_words(K.SOCIAL_WORDS, ignore_case=False))
    return out


def signals(subject: str, body: str, urls: str) -> str:
    f = flags(subject, body)
    parts = [f"CASE WHEN {f[f'L{i + 1}']} THEN {sql_str(label)} END" for i, (label, _) in enumerate(LANGUAGE_RE2)]
    parts += [f"CASE WHEN len({urls}) > 0 THEN CAST(len({urls}) AS VARCHAR) || {sql_str(K.REASON_URL_COUNT_SUFFIX)} END",
              first_finding(urls),
              f"CASE WHEN {f['L8']} THEN {sql_str(K.REASON_CAPITALS)} END",
              f"CASE WHEN {f['L9']} THEN {sql_str(K.REASON_PUNCTUATION)} END",
              f"CASE WHEN {f['L10']} THEN {sql_str(K.REASON_SOCIAL)} END"]
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def safe(signals_: str, urls: str, sender: str) -> str:
    has = lambda label: f"list_contains({signals_}, {sql_str(label)})"
    parts = [f"CASE WHEN len({urls}) = 0 THEN {sql_str(K.SAFE_NO_URLS)} END",
             f"CASE WHEN NOT ({has(K.REASON_PRIZE)} OR {has(K.REASON_PROMO)}) THEN {sql_str(K.SAFE_NO_PROMO)} END",
             f"CASE WHEN NOT ({has(K.REASON_CREDENTIALS)} OR {has(K.REASON_VERIFICATION)}) "
             f"THEN {sql_str(K.SAFE_NO_CREDENTIALS)} END",
             f"CASE WHEN {sender} = '' THEN {sql_str(K.SAFE_NO_SENDER)} END"]
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def topic(subject: str, body: str) -> str:
    low = f"lower({subject} || ' ' || {body})"
    whens = " ".join(f"WHEN {rx(folded(low), re2_words(words))} THEN {sql_str(name)}" for name, words in K.TOPICS)
    return f"CASE {whens} ELSE {sql_str(K.TOPIC_DEFAULT)} END"


# ---------------------------------------------------------------------------
# Sender
# ---------------------------------------------------------------------------

SENDER_SHAPE_RE2 = "^[^" + WS_CLASS + "@]+@[^" + WS_CLASS + "@]+\\.[^" + WS_CLASS + "@]+$"


def sender_domain(s: str) -> str:
    return f"(CASE WHEN contains({s}, '@') THEN lower(regexp_extract({s}, '([^@]*)$', 1)) ELSE '' END)"


def sender_checks(s: str):
    d = sender_domain(s)
    local = f"lower(split_part({s}, '@', 1))"
    sens = " OR ".join(f"contains({d}, '{w}')" for w in K.SENDER_SENSITIVE_WORDS)
    role = "(" + "|".join(K.SENDER_ROLE_WORDS) + ")"
    return [
        (K.SENDER_NO_AT, K.SENDER_NO_AT_SCORE, f"NOT contains({s}, '@')"),
        (K.SENDER_UNUSUAL, K.SENDER_UNUSUAL_SCORE, f"contains({s}, '@') AND NOT {rx(s, SENDER_SHAPE_RE2)}"),
        (K.SENDER_DOMAIN_SHAPE, K.SENDER_DOMAIN_SHAPE_SCORE,
         f"{d} <> '' AND ({rx(d, '^\\p{Nd}')} OR NOT contains({d}, '.'))"),
        (K.SENDER_ROLE, 0, f"{d} <> '' AND {rx(local, role)}"),
        (K.SENDER_SENSITIVE, K.SENDER_SENSITIVE_SCORE, f"{d} <> '' AND ({sens})"),
    ]


def sender_indicators(s: str) -> str:
    parts = [f"CASE WHEN {cond} THEN {sql_str(text)} END" for text, _, cond in sender_checks(s)]
    return f"CASE WHEN {s} = '' THEN NULL ELSE list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL) END"


def sender_base_score(s: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {cond} THEN {pts} ELSE 0 END"
                            for _, pts, cond in sender_checks(s) if pts) + ")"


def risk_level(x: str) -> str:
    whens = " ".join(f"WHEN {x} >= {t} THEN '{n}'" for t, n in K.RISK_LEVELS)
    return f"CASE {whens} ELSE '{K.RISK_LEVEL_DEFAULT}' END"


def joined(arr: str) -> str:
    """Flatten a string list for value comparison (NULL list stays NULL)."""
    return f"array_to_string({arr}, ' | ')"


def history_domain(sender: str) -> str:
    s = clean(sender)
    return (f"(CASE WHEN contains({s}, '@') THEN lower(regexp_extract({s}, '([^@]*)$', 1)) "
            f"WHEN {s} <> '' THEN {s} ELSE {sql_str(K.UNKNOWN_SENDER)} END)")


def distinct_ordered(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


TOKEN_RE2 = r"[\p{L}\p{N}_]{2,}"


def analysis_ctes(model_sql: str, intercept: float) -> list[str]:
    """DuckDB chain from ``canon`` to per-email results (``fin``)."""
    spam_terms = (f"CASE WHEN len(model_terms) > 0 THEN [{sql_str(K.SPAM_TERMS_PREFIX)} || "
                  f"array_to_string(model_terms, ', ')] ELSE [] END")
    ham_terms = (f"CASE WHEN len(model_terms) > 0 THEN [{sql_str(K.HAM_TERMS_PREFIX)} || "
                 f"array_to_string(model_terms, ', ')] ELSE [] END")
    spam_part = (f"list_concat(list_concat({distinct_ordered('signals')}, coalesce(sender_indicators, [])), "
                 f"{spam_terms})")
    ham_part = f"list_concat({distinct_ordered('safe_reasons')}, {ham_terms})"
    a, b, c = K.OVERALL_WEIGHTS
    return [
        f"rules AS (SELECT row_idx, subject, body, sender, {urls_expr('subject', 'body')} AS url_list, "
        f"trim('Subject: ' || subject || chr(10) || chr(10) || body, {WS_SQL}) AS text FROM canon)",
        f"sig AS (SELECT *, {signals('subject', 'body', 'url_list')} AS signals FROM rules)",
        f"sig2 AS (SELECT *, {safe('signals', 'url_list', 'sender')} AS safe_reasons, {topic('subject', 'body')} AS topic, "
        f"{sender_indicators('sender')} AS sender_indicators, {sender_base_score('sender')} AS sender_base, "
        f"list_filter(list_transform(url_list, lambda u: {url_error('u')}), lambda x: x IS NOT NULL)[1] AS url_error_text, "
        f"coalesce(list_bool_or(list_transform(url_list, lambda u: {invalid('u')})), false) AS url_error FROM sig)",
        f"model AS ({model_sql})",
        f"toks AS (SELECT row_idx, regexp_extract_all(strip_accents(lower(text)), '{TOKEN_RE2}') AS t FROM rules)",
        "terms AS (SELECT row_idx, unnest(t) AS term FROM toks UNION ALL "
        "SELECT row_idx, unnest(list_transform(t[2:], lambda x, i: t[i] || ' ' || x)) AS term FROM toks)",
        "tf AS (SELECT row_idx, term, count(*) AS tf FROM terms GROUP BY row_idx, term)",
        "wt AS (SELECT tf.row_idx, tf.term, tf.tf, (1 + ln(tf.tf)) * m.idf AS w, "
        "(1 + ln(tf.tf)) * m.idf * m.coef AS contrib FROM tf JOIN model m ON m.term = tf.term)",
        "sums AS (SELECT row_idx, sum(w * w) AS ss, sum(contrib) AS dot FROM wt GROUP BY row_idx)",
        f"sc AS (SELECT s.*, coalesce(CASE WHEN ss > 0 THEN dot / sqrt(ss) END, 0) + ({intercept}) AS margin "
        "FROM sig2 s LEFT JOIN sums USING (row_idx))",
        "sc2 AS (SELECT *, 100.0 / (1 + exp(-margin)) AS spam_risk FROM sc)",
        f"cand AS (SELECT row_idx, contrib > 0 AS pos, term, row_number() OVER (PARTITION BY row_idx, contrib > 0 "
        f"ORDER BY abs(contrib) DESC, term) AS rk FROM wt WHERE length(term) >= {K.EXPLAIN_MIN_TERM_LEN} AND contrib <> 0)",
        f"cands AS (SELECT row_idx, list(term ORDER BY rk) FILTER (WHERE pos AND rk <= {K.EXPLAIN_TOP_K}) AS spam_terms, "
        f"list(term ORDER BY rk) FILTER (WHERE NOT pos AND rk <= {K.EXPLAIN_TOP_K}) AS ham_terms FROM cand GROUP BY row_idx)",
        f"pr AS (SELECT sc2.*, CASE WHEN spam_risk >= {K.SPAM_THRESHOLD} THEN 'SPAM' ELSE 'HAM' END AS prediction, "
        "greatest(spam_risk, 100 - spam_risk) AS confidence, "
        f"coalesce(CASE WHEN spam_risk >= {K.SPAM_THRESHOLD} THEN spam_terms ELSE ham_terms END, []) AS model_terms "
        "FROM sc2 LEFT JOIN cands USING (row_idx))",
        f"rk AS (SELECT *, least(100, {K.CONTEXT_RISK_PER_SIGNAL} * len(signals)) AS ctx, "
        f"least(100, {K.URL_RISK_PER_URL} * len(url_list)) AS url_risk, "
        f"CASE WHEN prediction = 'SPAM' THEN {spam_part} ELSE {ham_part} END AS chosen FROM pr)",
        f"fin AS (SELECT *, least(100.0, greatest(0.0, round({a} * spam_risk + {b} * url_risk + {c} * ctx, 1))) AS overall, "
        f"{distinct_ordered(f'CASE WHEN len(chosen) = 0 THEN CASE WHEN prediction = {sql_str(K.SPAM)} THEN [{sql_str(K.SPAM_FALLBACK)}] ELSE [{sql_str(K.HAM_FALLBACK)}] END ELSE chosen END')} AS reasons, "
        f"CASE WHEN sender = '' THEN 0.0 ELSE round(least(100, sender_base + CASE WHEN prediction = 'SPAM' AND len(signals) > 0 "
        f"THEN least({K.SENDER_CONTEXT_MAX}, {K.SENDER_CONTEXT_PER_SIGNAL} * len(signals)) ELSE 0 END), 1) END AS sender_score "
        "FROM rk)",
    ]


def analysis_select() -> str:
    """Flattened RESULT columns from ``fin`` (error rows: NULL result)."""
    ok = "NOT url_error"
    items = ("array_to_string(list_transform(url_list, lambda u: u || ',' || coalesce(" + host("u") +
             ", '') || ',' || CASE WHEN " + is_https("u") + " THEN 'true' ELSE 'false' END), ' | ')")
    cols = {
        "prediction": "prediction",
        "spam_risk": "round(spam_risk, 1)",
        "confidence": "round(confidence, 1)",
        "overall_risk": "overall",
        "risk_level": risk_level("overall"),
        "domain_category": f"CASE WHEN prediction = 'HAM' THEN topic END",
        "reasons": "array_to_string(reasons, ' | ')",
        "urls_detected": "CAST(len(url_list) AS BIGINT)",
        "suspicious_urls": f"CAST({suspicious_count('url_list')} AS BIGINT)",
        "url_items": items,
        "context_score": "CAST(ctx AS DOUBLE)",
        "context_level": risk_level("ctx"),
        "context_indicators": "array_to_string(signals, ' | ')",
        "sender": "sender",
        "sender_domain": f"CASE WHEN sender = '' THEN '' ELSE {sender_domain('sender')} END",
        "sender_score": "CAST(sender_score AS DOUBLE)",
        "sender_verification": (f"CASE WHEN sender = '' THEN {sql_str(K.SENDER_VERIFICATION_EMPTY)} "
                                f"ELSE {sql_str(K.SENDER_VERIFICATION)} END"),
        "sender_indicators": "array_to_string(sender_indicators, ' | ')",
    }
    body = ", ".join(f"CASE WHEN {ok} THEN {v} END AS {k}" for k, v in cols.items())
    return f"row_idx, url_error_text AS error, {body}"
