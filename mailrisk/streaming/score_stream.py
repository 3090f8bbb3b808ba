"""A file stream of emails -> analysis -> appended detection history.

Each micro-batch is an ordinary DataFrame inside ``foreachBatch``, so the
per-email aggregations of the analysis need no streaming state.  The model
is a static table (broadcast behind its size check).  Every batch is one
version of the history table under its batch number, so a batch replayed after
a failure counts once, and every ``compact_every`` small batches are merged
into sorted files that remember which batches they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.analyze import analyze_emails
from ..sources.history_io import append_history, compact_history, history_records

RAW = ("sender", "recipient", "subject", "body")

EMAIL_STREAM_SCHEMA = T.StructType([
    T.StructField("row_idx", T.LongType()), T.StructField("sender", T.StringType()),
    T.StructField("recipient", T.StringType()), T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
])


def score_batch(batch: DataFrame, model: DataFrame, intercept: float, id_col: Column | None = None,
                created_at: Column | None = None) -> DataFrame:
    """History rows for one batch of emails (the batch form of T1)."""
    e = batch.select(*batch.columns, *[F.col(c).alias(f"raw_{c}") for c in RAW])
    keep = tuple(c for c in e.columns if c.startswith("raw_") or c == "created_at")
    res = analyze_emails(e, model, intercept, keep=keep)
    return history_records(res, id_col=id_col, created_at=created_at)


def start_score_stream(spark: SparkSession, input_dir: str, history_dir: str, checkpoint_dir: str,
                       model: DataFrame, intercept: float, schema: T.StructType = EMAIL_STREAM_SCHEMA,
                       id_col: Column | None = None, created_at: Column | None = None,
                       available_now: bool = True, max_files_per_trigger: int | None = None, compact_every: int = 64,
                       name: str = "stream"):
    """Start T1 and return the ``StreamingQuery``; streams that share a history need names of their own."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(input_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        append_history(score_batch(batch, model, intercept, id_col, created_at), history_dir, batch_id, stream=name)
        compact_history(spark, history_dir, at_least=compact_every)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
