"""Prediction, risk and reasons (M8, R1-R5) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import _c


def risk_level(score) -> Column:
    """>=85 CRITICAL, >=65 HIGH, >=35 MEDIUM, else LOW."""
    s = _c(score)
    out = None
    for threshold, name in K.RISK_LEVELS:
        out = F.when(s >= threshold, F.lit(name)) if out is None else out.when(s >= threshold, F.lit(name))
    return out.otherwise(F.lit(K.RISK_LEVEL_DEFAULT))


def prediction(spam_risk) -> Column:
    """M8: SPAM when the unrounded risk is at least 50."""
    return F.when(_c(spam_risk) >= K.SPAM_THRESHOLD, F.lit(K.SPAM)).otherwise(F.lit(K.HAM))


def confidence(spam_risk) -> Column:
    r = _c(spam_risk)
    return F.greatest(r, F.lit(100.0) - r)


def context_risk(n_signals) -> Column:
    """min(100, 12 x signals)."""
    return F.least(F.lit(100), _c(n_signals) * K.CONTEXT_RISK_PER_SIGNAL)


def overall_risk(spam_risk, url_risk, ctx_risk) -> Column:
    """R2: clamp(round(0.75 spam + 0.15 url + 0.10 context, 1), 0, 100) on unrounded inputs."""
    a, b, c = K.OVERALL_WEIGHTS
    raw = F.round(F.lit(a) * _c(spam_risk) + F.lit(b) * _c(url_risk) + F.lit(c) * _c(ctx_risk), 1)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))


def reasons(pred, signals, safe, sender_indicators, terms) -> Column:
    """Ordered, distinct reasons for the predicted class."""
    t = _c(terms)
    has_terms = F.coalesce(F.size(t), F.lit(0)) > 0
    joined_terms = F.array_join(t, ", ")
    spam_part = F.concat(
        F.array_distinct(_c(signals)),
        F.coalesce(_c(sender_indicators), F.array().cast("array<string>")),
        F.when(has_terms, F.array(F.concat(F.lit(K.SPAM_TERMS_PREFIX), joined_terms)))
        .otherwise(F.array().cast("array<string>")))
    ham_part = F.concat(
        F.array_distinct(_c(safe)),
        F.when(has_terms, F.array(F.concat(F.lit(K.HAM_TERMS_PREFIX), joined_terms)))
        .otherwise(F.array().cast("array<string>")))
    is_spam = _c(pred) == K.SPAM
    chosen = F.when(is_spam, spam_part).otherwise(ham_part)
    fallback = F.when(is_spam, F.array(F.lit(K.SPAM_FALLBACK))).otherwise(F.array(F.lit(K.HAM_FALLBACK)))
    return F.array_distinct(F.when(F.size(chosen) == 0, fallback).otherwise(chosen))


def domain_category(pred, topic) -> Column:
    """Topic for HAM, NULL for SPAM."""
    return F.when(_c(pred) == K.HAM, _c(topic))
