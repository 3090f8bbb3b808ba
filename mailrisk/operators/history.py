"""Detection history: listing, filters, search, delete, dashboard (H1-H8).

HISTORY columns: ``id, sender, recipient, subject, body, classification,
spam_risk, confidence, overall_risk, reasons, features, created_at``.  Every
report reads only the columns it needs, so Parquet scans prune the bodies and
JSON away, and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as TX

def newest_first():
    return [F.col("created_at").desc(), F.col("id").asc()]


def history_page(history: DataFrame, page_size: int) -> DataFrame:
    """H1 for one page: the newest ``page_size`` rows with their 1-based number.
    The number is assigned after the top-k, so no global window runs."""
    top = history.orderBy(*newest_first()).limit(page_size)
    return top.withColumn("number", F.row_number().over(Window.orderBy(*newest_first())))


def history_list(history: DataFrame) -> DataFrame:
    """H1 for the whole table: newest first with a 1-based ``number``.

    Only ``created_at`` and ``id`` are sorted (``positions_of``); the other
    columns meet their number in one join, so unused ones are pruned."""
    from .positions import positions_of
    return positions_of(history, ("id", "created_at"), "number", base=1, order=newest_first())


def history_by_class(history: DataFrame, classification: str) -> DataFrame:
    """H2."""
    return history.filter(F.col("classification") == classification)


def searched_text() -> "F.Column":
    """What H3 searches: lower-cased ``sender subject body`` (NULL as empty)."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("sender", "subject", "body")]))


def history_search(history: DataFrame, query: str) -> DataFrame:
    """H3: case-insensitive literal substring of ``sender subject body`` (NULL as empty)."""
    return history.filter(searched_text().contains(query.lower()))


def history_detail(history: DataFrame, record_id: str) -> DataFrame:
    """H4."""
    return history.filter(F.col("id") == record_id)


def history_delete(history: DataFrame, ids: DataFrame) -> DataFrame:
    """H5 on a frame: without the given ids; unknown ids are a no-op (``sources.history_io.delete_history`` rewrites the table)."""
    return history.join(ids.select("id").distinct(), "id", "left_anti")


def dashboard_totals(history: DataFrame) -> DataFrame:
    """H6: total, spam, not_spam."""
    spam = F.count_if(F.col("classification") == K.SPAM)
    return history.agg(F.count(F.lit(1)).alias("total"), spam.alias("spam"),
                       (F.count(F.lit(1)) - spam).alias("not_spam"))


def domain_key(sender) -> "F.Column":
    """H7 key: lower-cased text after the last '@'; without '@' the cleaned
    sender as is; empty -> 'Unknown sender'."""
    s = TX.clean(sender)
    return (F.when(s.contains("@"), F.lower(F.substring_index(s, "@", -1)))
            .when(s != "", s).otherwise(F.lit(K.UNKNOWN_SENDER)))


def domain_breakdown(history: DataFrame) -> DataFrame:
    """H7: spam/ham per sender key, by total desc, ties by most recent detection.

    Partial aggregation absorbs skewed keys (one domain may hold a third of
    the rows) before the shuffle; only two columns are read."""
    is_spam = F.col("classification") == K.SPAM
    agg = (history.select(domain_key(F.col("sender")).alias("domain"), "classification", "created_at")
           .groupBy("domain")
           .agg(F.count_if(is_spam).alias("spam"), F.count_if(~is_spam | F.col("classification").isNull()).alias("ham"),
                F.max("created_at").alias("_last")))
    return (agg.orderBy((F.col("spam") + F.col("ham")).desc(), F.col("_last").desc_nulls_last(), F.col("domain"))
            .drop("_last"))


def domain_percentages(breakdown: DataFrame) -> DataFrame:
    """H8: spam and ham shares in percent (2 decimals), 0 when the total is 0."""
    total = F.col("spam") + F.col("ham")
    pct = lambda c: F.when(total > 0, F.round(F.col(c) / total * 100.0, 2)).otherwise(F.lit(0.0))
    return breakdown.withColumn("spam_pct", pct("spam")).withColumn("ham_pct", pct("ham"))
