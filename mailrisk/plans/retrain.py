"""Retraining job (M11, M12): corpora -> cleaned training table -> split ->
fit -> metrics -> model and corpus written -> report as (metric, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import corpus as C
from ..operators import text_model as M
from ..operators import training as T
from ..session import shared_dir
from ..sources import paths
from ..sources.corpus_io import load_corpus, write_corpus
from ..sources.model_store import save_model


def prepare_training(canon: DataFrame) -> DataFrame:
    """C8 + C10 with a unique dense document id ``doc`` in merged input order."""
    table = C.training_table(canon)
    return C.dense_index(C.combine_text(table), order=["src_ord", "row_idx"], out="doc")


def evaluate(test: DataFrame, model_terms: DataFrame, intercept: float) -> DataFrame:
    """M10 on the held-out side: predicted SPAM when the risk is at least 50."""
    scored = M.score(test.select("doc", "label", "text"), model_terms, intercept)
    pred = scored.withColumn("pred", (F.col("spam_risk") >= K.SPAM_THRESHOLD).cast("int"))
    return T.classification_metrics(pred, "label", "pred")


def training_report(funnel: DataFrame, raw: DataFrame, labels: DataFrame, metrics: DataFrame) -> DataFrame:
    """The run summary as long (metric, value) rows."""
    def longify(df, cols, prefix=""):
        return df.select(F.explode(F.array(*[F.struct(F.lit(prefix + c).alias("metric"),
                                                      F.col(c).cast("double").alias("value")) for c in cols]))
                         .alias("m")).select("m.*")
    parts = [
        longify(funnel, funnel.columns),
        raw.select(F.concat(F.lit("raw_counts."), F.col("source")).alias("metric"), F.col("n").cast("double").alias("value")),
        labels.select(F.concat(F.lit("label_counts."), F.col("label").cast("string")).alias("metric"),
                      F.col("n").cast("double").alias("value")),
        longify(metrics, metrics.columns, "metrics."),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retrain(frames, out_dir: str, max_iter: int = 100):
    """Merge (S3), clean (C8), split (M1), fit (M3-M6), evaluate (M10),
    write the model (S8) and the merged cleaned corpus (S4), report (M11).

    Returns ``(report, model_terms, intercept)``; the written tables are the
    model's durable form, so later jobs read them instead of this lineage."""
    canon = C.merge_corpora(frames)
    spark = canon.sparkSession
    path = shared_dir(spark, "training-table")
    prepare_training(canon).write.parquet(path)
    table = spark.read.parquet(path)  # everything below reads the cleaned table, not the inputs again
    split = T.stratified_split(table, order=("src_ord", "row_idx"))
    train = split.filter(~F.col("is_test"))
    test = split.filter(F.col("is_test"))
    model_terms, intercept, n_docs = T.fit_spam_model(train, id_col="doc", max_iter=max_iter)
    save_model(model_terms, intercept, n_docs, f"{out_dir}/model")
    write_corpus(table.select(*[c for c in C.CORPUS_COLUMNS if c in table.columns]), f"{out_dir}/corpus")
    terms = spark.read.parquet(f"{out_dir}/model/terms")
    metrics = evaluate(test, terms, intercept)
    report = training_report(C.cleaning_funnel(canon), C.raw_counts(canon),
                             C.label_distribution(table), metrics)
    return report, terms, intercept


def retrain_paths(spark, canonical_path: str, extra_paths, out_dir: str, max_iter: int = 100):
    """M12 from files: every input path is checked before any work starts,
    then each file is read (S1) and resolved (S2) with its own layout, the
    canonical corpus first and the extras in argument order (S3)."""
    inputs = [canonical_path, *extra_paths]
    missing = [p for p in inputs if not paths.exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"input not found: {missing[0]}")
    frames = [load_corpus(spark, p, source="canonical" if i == 0 else p.rstrip("/").rsplit("/", 1)[-1], src_ord=i)
              for i, p in enumerate(inputs)]
    return retrain(frames, out_dir, max_iter=max_iter)
