"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import shared_dir
from . import caps, chat, collocations, compression, decontaminate, language, near_dedup, packing, quality, token_files, toxicity, trie, warc
from .common import table


def op1_chat_format(spark, sf_dir):
    """All conversations, and conversation -7, whose texts hold control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
                                F.lit(said).alias("text"))
    return chat.op1_chat_format(rows.unionByName(own))


def op2_language_id(spark, sf_dir):
    return language.op2_language(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark, sf_dir):
    return near_dedup.op3_near_duplicates(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark, sf_dir):
    return caps.op4_cap_filters(table(spark, sf_dir, "embeddings"))


def op5_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return token_files.op5_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "op5"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.op6_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc_archive(spark, sf_dir):
    return warc.op7_warc(table(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark, sf_dir):
    return packing.op8_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark, sf_dir):
    return toxicity.op9_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality(spark, sf_dir):
    return quality.op10_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_compression_bands(spark, sf_dir):
    return compression.op11_compression_bands(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return trie.op12_prefix_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark, sf_dir):
    return collocations.op13_collocations(table(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_chat_format": (op1_chat_format, None),
    "op2_language_id": (op2_language_id, None),
    "op3_minhash_dedup": (op3_minhash_dedup, None),
    "op4_embedding_dedup": (op4_embedding_dedup, None),
    "op5_token_files": (op5_token_files, None),
    "op6_decontamination": (op6_decontamination, decontaminate.ORACLE),
    "op7_warc_archive": (op7_warc_archive, warc.ORACLE),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_quality": (op10_quality, None),
    "op11_compression_bands": (op11_compression_bands, None),
    "op12_prefix_trie": (op12_prefix_trie, trie.ORACLE),
    "op13_collocations": (op13_collocations, collocations.ORACLE),
}
