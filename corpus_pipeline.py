"""The corpus pipeline: ``documents`` through five stages, each on all that its predecessor kept.

1. quality      documents that the quality classifier rejects go
2. language     documents whose language is not recognised go
3. near-dedup   one document of each group of near-duplicates stays (5-word shingles, similarity 0.8)
4. decontaminate  documents in which a benchmark window occurs go
5. packing      documents become token pieces in sequences of 2048

All stages but the last return the columns of ``documents``; ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again as the next one's input.
Empty tables pass through; rows with nulls are treated as each operator's module states.
"""

from __future__ import annotations

import public_tokenizers

from mailrisk.llm import decontaminate, language, near_dedup, packing, quality
from mailrisk.llm.common import stored, table


def quality_stage(spark, docs, sf_dir):
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark, docs, sf_dir):
    return language.keep_recognised(docs)


def near_dedup_stage(spark, docs, sf_dir):
    return near_dedup.keep_one_of_each(docs)


def decontamination_stage(spark, docs, sf_dir):
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    return packing.op8_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near-dedup", near_dedup_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # the classifiers and the packing search have no SQL form; tests hold the run against brute force


def run(spark, sf_dir):
    """Apply the stages to ``documents``; returns the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
