"""Whole-table email analysis (R1-R7): rules + model score + explanation -> RESULT.

``analyze_emails`` is a single branch over the input: the rules are column
expressions of the row, and ``text_model.score`` carries the compact rule row
(labels, counts, topic; no text) beside the row's terms through one exchange
of about one row an email.  Columns named in ``keep`` (raw fields for the
history) travel in the same row, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import risk as RK
from ..functions import sender as D
from ..functions import text as TX
from ..functions import urls as U
from . import rules as R
from . import text_model as M

COMPACT = ["row_idx", "sender", "url_list", "signals", "n_signals", "safe_reasons", "topic",
           "urls_detected", "suspicious_urls", "url_risk", "url_error"]


def rule_table(emails: DataFrame) -> DataFrame:
    """Cleaned fields + every rule column + the combined model text."""
    cleaned = R.clean_email_fields(emails)
    return R.with_signals(cleaned).withColumn("text", TX.combine_text("subject", "body"))


def analyze_emails(emails: DataFrame, model: DataFrame, intercept: float, keep: tuple = ()) -> DataFrame:
    """One RESULT per input row, whatever its ``row_idx`` (which is passed on; flattened and nested fields).

    A row whose urls cannot be parsed gets ``error`` (its cause) and NULL result fields;
    the rest of the table is unaffected.  ``keep`` names extra input columns
    (e.g. raw fields for the history) carried along.
    """
    ruled = R.with_topic(rule_table(emails))
    scored = M.predict(M.score(ruled.select(*COMPACT, *keep, "text"), model, intercept))
    return assemble(M.explain_terms(scored))


def assemble(df: DataFrame) -> DataFrame:
    pred = F.col("prediction")
    ctx = RK.context_risk("n_signals")
    overall = RK.overall_risk("spam_risk", "url_risk", ctx)
    sender_struct = D.analysis("sender", pred, "n_signals")
    reasons = RK.reasons(pred, "signals", "safe_reasons", sender_struct["indicators"], "model_terms")
    ok = F.col("url_error").isNull()
    result = {
        "error": F.col("url_error"),
        "prediction": F.when(ok, pred),
        "classification": F.when(ok, pred),
        "spam_risk": F.when(ok, F.round("spam_risk", 1)),
        "confidence": F.when(ok, F.round("confidence", 1)),
        "overall_risk": F.when(ok, overall),
        "risk_level": F.when(ok, RK.risk_level(overall)),
        "domain_category": F.when(ok, RK.domain_category(pred, "topic")),
        "reasons": F.when(ok, reasons),
        "url_analysis": F.when(ok, F.struct(
            F.col("urls_detected").alias("urls_detected"), F.col("suspicious_urls").alias("suspicious_urls"),
            U.items("url_list").alias("items"), F.lit(K.URL_REPUTATION).alias("reputation"))),
        "context_analysis": F.when(ok, F.struct(
            F.round(ctx.cast("double"), 1).alias("score"), RK.risk_level(ctx).alias("level"),
            F.col("signals").alias("indicators"))),
        "sender_analysis": F.when(ok, sender_struct),
        "explanation": F.when(ok, F.lit("")),
    }
    extra = [c for c in df.columns if c not in COMPACT and c not in
             ("margin", "spam_risk", "prediction", "confidence", "model_terms")]
    return df.select("row_idx", *[v.alias(k) for k, v in result.items()], *extra)


def flatten(results: DataFrame) -> DataFrame:
    """RESULT with arrays joined by ' | ' and structs spread (for reports and oracles)."""
    items = F.transform("url_analysis.items", lambda i: F.concat_ws(
        ",", i["url"], i["domain"], F.when(i["https"], F.lit("true")).otherwise(F.lit("false"))))
    return results.select(
        "row_idx", "error", "prediction", "spam_risk", "confidence", "overall_risk", "risk_level",
        "domain_category", F.array_join("reasons", " | ").alias("reasons"),
        F.col("url_analysis.urls_detected").cast("long").alias("urls_detected"),
        F.col("url_analysis.suspicious_urls").cast("long").alias("suspicious_urls"),
        F.array_join(items, " | ").alias("url_items"),
        F.col("context_analysis.score").alias("context_score"),
        F.col("context_analysis.level").alias("context_level"),
        F.array_join("context_analysis.indicators", " | ").alias("context_indicators"),
        F.col("sender_analysis.sender").alias("sender"),
        F.col("sender_analysis.domain").alias("sender_domain"),
        F.col("sender_analysis.score").alias("sender_score"),
        F.col("sender_analysis.verification").alias("sender_verification"),
        F.array_join("sender_analysis.indicators", " | ").alias("sender_indicators"))


def risk_level_summary(results: DataFrame) -> DataFrame:
    """Emails per prediction x risk level; rows on the error path form the NULL group."""
    return (results.groupBy("prediction", "risk_level").agg(F.count(F.lit(1)).alias("n")))
