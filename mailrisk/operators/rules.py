"""Rule signals over whole email tables.

All rules are column expressions added in one projection over cleaned
emails: no shuffle, no Python worker.  ``urls`` and the signal array are
materialised once as columns and reused by every later rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sender as D
from ..functions import signals as L
from ..functions import urls as U

LANGUAGE_FLAG_NAMES = ["urgent", "credentials", "verification", "financial", "prize", "promotional",
                       "call_to_action", "capitals", "punctuation", "social_engineering"]


def clean_email_fields(df: DataFrame, cols=("subject", "body", "sender", "recipient")) -> DataFrame:
    """C1 on the fields an analysis reads."""
    from ..functions.text import clean
    return df.withColumns({c: clean(c) for c in cols if c in df.columns})


def with_urls(df: DataFrame) -> DataFrame:
    """U1 as ``url_list`` (the corpus' own ``urls`` text column is not used by the rules)."""
    return df.withColumn("url_list", U.extract_urls("subject", "body"))


def with_rule_text(df: DataFrame) -> DataFrame:
    """Materialise the searched texts once: ``_txt`` = subject \n body, ``_low`` its lower case, ``_plain`` that for the guards."""
    return (df.withColumn("_txt", F.concat("subject", F.lit("\n"), "body"))
            .withColumn("_low", F.lower("_txt"))
            .withColumn("_plain", L.plain("_low")))


def with_language_flags(df: DataFrame) -> DataFrame:
    """L1-L10 as named boolean columns."""
    flags = L.rule_flags("_low", "_txt", "_plain")
    return (with_rule_text(df)
            .withColumns({name: flags[f"L{i + 1}"] for i, name in enumerate(LANGUAGE_FLAG_NAMES)})
            .drop("_txt", "_low", "_plain"))


def with_signals(df: DataFrame) -> DataFrame:
    """U1, L11, L12 and the url report columns (U3-U7); the topic (L13) is
    added where needed (``with_topic``) because only HAM results use it."""
    df = with_urls(df) if "url_list" not in df.columns else df
    return (with_rule_text(df).withColumn("signals", L.signal_reasons("_low", "_txt", "url_list", "_plain"))
            .drop("_txt", "_low", "_plain")
            .withColumn("n_signals", F.size("signals"))
            .withColumn("safe_reasons", L.safe_reasons("signals", "url_list", "sender"))
            .withColumn("urls_detected", F.size("url_list"))
            .withColumn("suspicious_urls", U.suspicious_count("url_list"))
            .withColumn("url_risk", U.url_risk("url_list"))
            .withColumn("url_error", U.first_error("url_list")))


def with_topic(df: DataFrame) -> DataFrame:
    """L13."""
    return (df.withColumn("_lows", L.topic_text("subject", "body")).withColumn("_plains", L.plain("_lows"))
            .withColumn("topic", L.topic("_lows", "_plains")).drop("_lows", "_plains"))


def url_items(df: DataFrame) -> DataFrame:
    """One row per email x url with 0-based position, host and https flag."""
    return (df.select("row_idx", F.posexplode("url_list").alias("pos", "url"))
            .select("row_idx", "pos", "url", F.coalesce(U.host("url"), F.lit("")).alias("domain"),
                    U.is_https("url").alias("https"), U.is_invalid("url").alias("invalid")))


def url_report(df: DataFrame) -> DataFrame:
    """U3-U7 per email."""
    return df.select(
        "row_idx",
        U.count_signal("url_list").alias("url_count_reason"),
        U.first_finding("url_list").alias("first_finding"),
        F.size("url_list").alias("urls_detected"),
        U.suspicious_count("url_list").alias("suspicious_urls"),
        F.round(U.suspicious_share(U.suspicious_count("url_list"), F.size("url_list")), 6).alias("suspicious_share"),
        U.url_risk("url_list").alias("url_risk"))


def signal_summary(df: DataFrame) -> DataFrame:
    """Emails per fired signal label (labels are distinct within an email).

    The outer form keeps the optimizer from adding a ``size(signals) > 0`` filter, which it would push
    below the staged projections to the scan, with the rules written out once per use of a text."""
    fired = df.select(F.explode_outer("signals").alias("signal")).filter(F.col("signal").isNotNull())
    return fired.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def sender_report(df: DataFrame) -> DataFrame:
    """D1-D5 per email: domain, rule score before the SPAM context add-on, indicators."""
    s = F.col("sender")
    return df.select("row_idx", "sender",
                     D.domain(s).alias("sender_domain"),
                     F.when(s == "", F.lit(0)).otherwise(D.base_score(s)).alias("base_score"),
                     D.indicators(s).alias("indicators"))
