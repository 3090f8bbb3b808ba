"""Bounded, deterministic samples of labelled rows for the classifiers that fit on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(labelled: DataFrame, label: str) -> dict:
    """Rows of each label value; label values are few by nature."""
    return {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}


def sample_by_class(labelled: DataFrame, label: str, counts: dict, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label value at most, chosen by a hash of doc_id.

    Rows stay where they lie; :func:`bound` is the hard limit on what is then made of them.
    """
    if not counts:
        return labelled.limit(0)
    rate = F.lit(1.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(rate)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30))
    return labelled.filter(uniform < rate)


def bound(counts: dict, per_class: int) -> int:
    """Rows that may reach the driver, for tables whose ids repeat."""
    return 2 * per_class * max(1, len(counts))
