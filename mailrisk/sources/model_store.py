"""Model persistence (S8): term table + one-row metadata, both Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_model(model_terms: DataFrame, intercept: float, n_docs: int, path: str) -> None:
    spark = model_terms.sparkSession
    model_terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(float(intercept), int(n_docs))], "intercept double, n_docs long") \
        .write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str):
    """Returns ``(model_terms, intercept)``; the intercept is one scalar read on the driver."""
    terms = spark.read.parquet(f"{path}/terms")
    meta = spark.read.parquet(f"{path}/meta").select(F.col("intercept")).first()
    return terms, float(meta["intercept"])
