"""Language, formatting and safe signals (L1-L13) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .regex import PUNCT_RUNS, java_verification, java_words, required_literals
from .text import _c, joined
from . import urls as U

# Rule table: (reason label, Java pattern, literals) in reporting order L1..L7.
# Every match contains one of the literals, so a cheap ``contains`` test
# decides whether the regex needs to run at all (most mail hits no rule).
LANGUAGE_RULES = [
    (K.REASON_URGENT, java_words(K.URGENT_WORDS), required_literals(K.URGENT_WORDS)),
    (K.REASON_CREDENTIALS, java_words(K.CREDENTIAL_WORDS), required_literals(K.CREDENTIAL_WORDS)),
    (K.REASON_VERIFICATION, java_verification(), required_literals(K.VERIFY_LEAD_WORDS + K.SIGN_IN_WORDS)),
    (K.REASON_FINANCIAL, java_words(K.FINANCIAL_WORDS), required_literals(K.FINANCIAL_WORDS)),
    (K.REASON_PRIZE, java_words(K.PRIZE_WORDS), required_literals(K.PRIZE_WORDS)),
    (K.REASON_PROMO, java_words(K.PROMO_WORDS), required_literals(K.PROMO_WORDS)),
    (K.REASON_CTA, java_words(K.CTA_WORDS), required_literals(K.CTA_WORDS)),
]
SOCIAL_PATTERN = java_words(K.SOCIAL_WORDS, ignore_case=False)
SOCIAL_LITERALS = required_literals(K.SOCIAL_WORDS)
TOPIC_RULES = [(name, java_words(words), required_literals(words)) for name, words in K.TOPICS]

# Characters of lower-cased text that case-insensitively equal an ASCII letter
# without being one: dotless i and long s.
FOLDS = "\u0131\u017f"
FOLDS_TO = "is"


def plain(low) -> Column:
    """Lower-cased text with look-alikes of ASCII letters as these letters; materialise it once for the guards."""
    c = _c(low)
    return F.when(c.contains(FOLDS[0]) | c.contains(FOLDS[1]), F.translate(c, FOLDS, FOLDS_TO)).otherwise(c)


def guarded_rlike(low: Column, pattern: str, literals, guard: Column) -> Column:
    """``low rlike pattern``, evaluated only when a required literal occurs in ``guard``
    (``plain(low)``, or ``low`` itself for a pattern that minds case)."""
    hit = F.lit(False)
    for lit in literals:
        hit = hit | guard.contains(lit)
    return F.when(hit, low.rlike(pattern)).otherwise(F.lit(False))


def rule_text(subject, body) -> Column:
    """Lower-cased ``subject \\n body`` searched by the keyword rules."""
    return F.lower(joined(subject, body, "\n"))


def capitals(txt) -> Column:
    """At least 20 letters and an upper-case share above 0.35 (original case).

    Letters are counted whole only where neither the least number of letters nor the letters
    at the text's beginning already make the capitals too few."""
    t, share = _c(txt), int(K.CAPITALS_SHARE * 100)
    letters = lambda x: F.length(F.regexp_replace(x, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
    return (F.when(upper * 100 <= K.CAPITALS_MIN_LETTERS * share, F.lit(False))
            .when(upper * 100 <= letters(F.substr(t, F.lit(1), upper * 6)) * share, F.lit(False))
            .otherwise((letters(t) >= K.CAPITALS_MIN_LETTERS) & (upper * 100 > letters(t) * share)))


def punctuation(txt) -> Column:
    """At least two runs of '!!' or '??'."""
    t = _c(txt)
    runs = F.regexp_count(t, F.lit(PUNCT_RUNS)) >= K.PUNCTUATION_MIN_RUNS
    return F.when(t.contains("!!") | t.contains("??"), runs).otherwise(F.when(t.isNotNull(), F.lit(False)))


def rule_flags(low, txt, folded=None) -> dict[str, Column]:
    """Boolean column per rule, keyed L1..L10, over materialised columns:
    ``low`` = lower(subject \n body), ``txt`` = subject \n body and ``folded`` = plain(low).  (Passing
    expressions instead would re-evaluate them in every conditional branch.)"""
    low = _c(low)
    guard = plain(low) if folded is None else _c(folded)
    flags = {f"L{i + 1}": guarded_rlike(low, p, lits, guard) for i, (_, p, lits) in enumerate(LANGUAGE_RULES)}
    flags["L8"] = capitals(txt)
    flags["L9"] = punctuation(txt)
    flags["L10"] = guarded_rlike(low, SOCIAL_PATTERN, SOCIAL_LITERALS, low)
    return flags


def signal_reasons(low, txt, urls, folded=None) -> Column:
    """Ordered labels of the rules that fired."""
    f = rule_flags(low, txt, folded)
    parts = [F.when(f[f"L{i + 1}"], F.lit(label)) for i, (label, _, _) in enumerate(LANGUAGE_RULES)]
    parts += [U.count_signal(urls), U.first_finding(urls),
              F.when(f["L8"], F.lit(K.REASON_CAPITALS)),
              F.when(f["L9"], F.lit(K.REASON_PUNCTUATION)),
              F.when(f["L10"], F.lit(K.REASON_SOCIAL))]
    return F.array_compact(F.array(*parts))


def safe_reasons(signals, urls, sender) -> Column:
    """HAM-supporting reasons, derived from the fired labels, urls and cleaned sender."""
    sig = _c(signals)
    has = lambda label: F.array_contains(sig, label)
    return F.array_compact(F.array(
        F.when(F.size(_c(urls)) == 0, F.lit(K.SAFE_NO_URLS)),
        F.when(~(has(K.REASON_PRIZE) | has(K.REASON_PROMO)), F.lit(K.SAFE_NO_PROMO)),
        F.when(~(has(K.REASON_CREDENTIALS) | has(K.REASON_VERIFICATION)), F.lit(K.SAFE_NO_CREDENTIALS)),
        F.when(_c(sender) == "", F.lit(K.SAFE_NO_SENDER)),
    ))


def topic_text(subject, body) -> Column:
    return F.lower(joined(subject, body, " "))


def topic(low_space, folded=None) -> Column:
    """First matching topic of a materialised lower(subject + ' ' + body), else General."""
    low = _c(low_space)
    guard = plain(low) if folded is None else _c(folded)
    out = None
    for name, pattern, lits in TOPIC_RULES:
        hit = guarded_rlike(low, pattern, lits, guard)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(K.TOPIC_DEFAULT))
