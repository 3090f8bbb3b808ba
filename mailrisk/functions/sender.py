"""Sender checks (D1-D7) as column expressions over a cleaned sender."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .regex import SENDER_SHAPE
from .text import _c

_ROLE = "(?:" + "|".join(K.SENDER_ROLE_WORDS) + ")"


def domain(sender) -> Column:
    """Lower-cased text after the last '@', '' without '@'."""
    s = _c(sender)
    return F.when(s.contains("@"), F.lower(F.substring_index(s, "@", -1))).otherwise(F.lit(""))


def _checks(sender):
    """(indicator, score, fired) triples in reporting order."""
    s = _c(sender)
    d = domain(s)
    has_at = s.contains("@")
    local = F.lower(F.substring_index(s, "@", 1))
    sensitive = F.lit(False)
    for w in K.SENDER_SENSITIVE_WORDS:
        sensitive = sensitive | d.contains(w)
    has_domain = d != ""
    return [
        (K.SENDER_NO_AT, K.SENDER_NO_AT_SCORE, ~has_at),                                   # D2
        (K.SENDER_UNUSUAL, K.SENDER_UNUSUAL_SCORE, has_at & ~s.rlike(SENDER_SHAPE)),       # D2
        (K.SENDER_DOMAIN_SHAPE, K.SENDER_DOMAIN_SHAPE_SCORE,
         has_domain & (d.rlike(r"^\p{Nd}") | ~d.contains("."))),                           # D3
        (K.SENDER_ROLE, 0, has_domain & local.rlike(_ROLE)),                               # D4
        (K.SENDER_SENSITIVE, K.SENDER_SENSITIVE_SCORE, has_domain & sensitive),            # D5
    ]


def indicators(sender) -> Column:
    """Ordered indicator texts; NULL for an empty sender."""
    arr = F.array_compact(F.array(*[F.when(fired, F.lit(text)) for text, _, fired in _checks(sender)]))
    return F.when(_c(sender) == "", F.lit(None).cast("array<string>")).otherwise(arr)


def base_score(sender) -> Column:
    total = F.lit(0)
    for _, pts, fired in _checks(sender):
        if pts:
            total = total + F.when(fired, F.lit(pts)).otherwise(F.lit(0))
    return total


def context_addon(prediction, n_signals) -> Column:
    """SPAM with signals adds min(25, 4 x signals)."""
    n = _c(n_signals)
    return F.when((_c(prediction) == K.SPAM) & (n > 0),
                  F.least(F.lit(K.SENDER_CONTEXT_MAX), n * K.SENDER_CONTEXT_PER_SIGNAL)).otherwise(F.lit(0))


def score(sender, prediction, n_signals) -> Column:
    """D7 score: clamped to 100; 0 for an empty sender."""
    s = _c(sender)
    raw = base_score(s) + context_addon(prediction, n_signals)
    return F.when(s == "", F.lit(0.0)).otherwise(F.round(F.least(F.lit(100), raw).cast("double"), 1))


def analysis(sender, prediction, n_signals) -> Column:
    """The sender_analysis struct."""
    s = _c(sender)
    empty = s == ""
    return F.struct(
        s.alias("sender"),
        F.when(empty, F.lit("")).otherwise(domain(s)).alias("domain"),
        score(s, prediction, n_signals).alias("score"),
        F.when(empty, F.lit(K.SENDER_VERIFICATION_EMPTY)).otherwise(F.lit(K.SENDER_VERIFICATION))
        .alias("verification"),
        indicators(s).alias("indicators"),
    )
