"""Test inputs derived from the driver tables (see FIXTURES.md).

``EMAILS_SQL`` is one SQL text that both Spark and DuckDB run over the
``documents``/``labels``/``events`` tables; it only shapes rows into the email
schema (sender, recipient, subject, body, raw label, time) and does none of
the engine's work.  ``MODEL_TERMS`` is a small fixed term-weight table used as
the model parameter where exact scoring oracles are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

EMAILS_SQL = """SELECT d.doc_id AS row_idx,
 CASE d.doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'alice@example.com' WHEN 2 THEN 'no-reply@account-alert.com'
  WHEN 3 THEN 'bob' WHEN 4 THEN 'promo@9deals.net' WHEN 5 THEN 'x y@corp' WHEN 6 THEN 'Team@Example.COM' WHEN 7 THEN 'abc@' ELSE ' ' END AS sender,
 'user' || CAST(d.doc_id % 50 AS VARCHAR(10)) || '@example.org' AS recipient,
 CASE d.n_chars % 8 WHEN 0 THEN 'Final notice: act now' WHEN 1 THEN 'Project meeting agenda' WHEN 2 THEN 'You have won a prize'
  WHEN 3 THEN 'Family dinner' WHEN 4 THEN 'Invoice and payment' WHEN 5 THEN ' ' WHEN 6 THEN 'OFFER: LIMITED TIME' ELSE 'Course lecture' END AS subject,
 CASE WHEN d.n_chars % 37 = 0 AND d.n_chars % 8 = 5 THEN '' ELSE
 (CASE WHEN d.n_chars % 29 = 0 AND d.lang = 'en' THEN upper(d.text) ELSE d.text END) || ' ' ||
 CASE d.n_chars % 11 WHEN 0 THEN 'please verify your account login' WHEN 1 THEN 'send your password or otp' WHEN 2 THEN 'click here!! now?? ok'
  WHEN 3 THEN 'gift card, keep this confidential' WHEN 4 THEN 'wire transfer refund' WHEN 5 THEN 'unsubscribe from newsletter' WHEN 6 THEN 'community event invite' WHEN 7 THEN 'tax statement' ELSE '' END || ' ' ||
 CASE d.n_chars % 13 WHEN 0 THEN 'see https://10.0.0.1/x, and http://a.example.com/). https://b.example.com https://c.example.com' WHEN 1 THEN 'HTTPS://Pay.example.com/Secure-Login?x=1;' WHEN 2 THEN 'https://ok.example.com/a https://ok.example.com/a.'
  WHEN 3 THEN 'https://user@evil.example.com/' WHEN 4 THEN 'http://plain.example.com' WHEN 5 THEN 'https://[::1/x' ELSE '' END END AS body,
 CASE WHEN l.doc_id IS NULL THEN CASE d.doc_id % 5 WHEN 0 THEN 'maybe' WHEN 1 THEN 'Spam ' ELSE NULL END
  ELSE CASE WHEN l.quality = 0 THEN CASE d.doc_id % 3 WHEN 0 THEN 'SPAM' WHEN 1 THEN '1.0' ELSE 'yes' END
       ELSE CASE d.doc_id % 4 WHEN 0 THEN 'ham' WHEN 1 THEN '0' WHEN 2 THEN 'not_spam' ELSE 'Non-Spam' END END END AS label_raw,
 e.ts AS created_at
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id"""

# Fixed model parameter: (term, idf, coef); intercept below.
MODEL_TERMS = [
    ("verify", 5.0, 9.0), ("account", 4.0, 7.0), ("login", 5.0, 8.0),
    ("password", 5.0, 9.0), ("otp", 6.0, 8.0), ("click here", 6.0, 9.0),
    ("gift card", 6.0, 9.0), ("wire transfer", 6.0, 7.0), ("prize", 5.0, 8.0),
    ("act now", 5.0, 9.0), ("unsubscribe", 4.0, 6.0), ("offer", 4.0, 5.0),
    ("payment", 4.0, 3.0), ("meeting", 4.0, -8.0), ("agenda", 5.0, -7.0),
    ("family", 5.0, -8.0), ("dinner", 5.0, -7.0), ("course", 4.0, -8.0),
    ("lecture", 5.0, -9.0), ("community", 5.0, -6.0), ("the", 1.5, -1.0),
    ("is", 1.5, -0.5), ("und", 2.0, -0.5), ("subject project", 5.0, -4.0),
    ("subject final", 5.0, 4.0),
]
MODEL_INTERCEPT = -0.5

MODEL_SCHEMA = T.StructType([
    T.StructField("term", T.StringType(), False),
    T.StructField("idf", T.DoubleType(), False),
    T.StructField("coef", T.DoubleType(), False),
])


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the driver's parquet tables as temp views."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The EMAILS view over the driver tables of ``sf_dir``.

    A small driver table is a single Parquet file with one row group, which a
    scan reads in one task; then the rows are spread round-robin over the cores so
    the per-row rule work of the jobs runs in parallel, as it does on a real
    multi-file input, whose texts are not moved for it.  Results never depend on this layout."""
    register_tables(spark, sf_dir, ["documents", "labels", "events"])
    rows, cores = spark.sql(EMAILS_SQL), spark.sparkContext.defaultParallelism
    tasks = spark.table("documents").groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    return rows if tasks[0] and tasks[1] * cores <= 2 * tasks[0] else rows.repartition(cores)


def model_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_TERMS, MODEL_SCHEMA)


def model_terms_sql() -> str:
    rows = ", ".join(f"('{t}', {i}, {c})" for t, i, c in MODEL_TERMS)
    return f"SELECT * FROM (VALUES {rows}) AS m(term, idf, coef)"
