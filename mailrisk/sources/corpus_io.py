"""Corpus sources and sinks.

Files are read with an explicit row order: ``_row_order`` is the 0-based
position of the row in the input (files in path order, rows in file order),
which keep-first dedup and positional lookup depend on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schema as SC
from ..operators import corpus as C
from . import csv_split as S
from . import file_index as X
from . import paths
from . import table_log as L

PARQUET_SUFFIXES = (".parquet", ".parquet.gzip", ".gzip")


def _with_file_order(df: DataFrame, pos: F.Column) -> DataFrame:
    """Dense input position from (file path, position in file).

    One count per file (a tiny table) gives file offsets by a running sum; no
    task sees more than its own split."""
    from pyspark.sql import Window
    tagged = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_fpos", pos)
    sizes = tagged.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_fpos").alias("_min"))
    running = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.withColumn("_off", F.sum("_n").over(running) - F.col("_n"))
    return (tagged.join(offsets, "_file")
            .withColumn("_row_order", F.col("_off") + F.col("_fpos") - F.col("_min"))
            .drop("_file", "_fpos", "_n", "_min", "_off"))


CSV_OPTIONS = {"multiLine": "true", "escape": '"', "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as all-string columns; pandas' missing-value tokens become NULL.

    Bodies contain newlines.  Plain files that are quoted as RFC 4180 has it are cut at any
    byte (``csv_split``); the others are read by one task a file, in which a row's position is
    the task's increasing id."""
    raw = spark.read.options(header=True, **CSV_OPTIONS).csv(path)
    known = [F.when(C.column(c).isin(K.CSV_NULL_TOKENS), None).otherwise(C.column(c)).alias(c) for c in raw.columns]
    cut = S.read(spark, path, raw.columns, CSV_OPTIONS) if raw.columns else None
    if cut is not None:
        return cut.select(*known, "_row_order")
    ordered = _with_file_order(raw.select(*known, "_metadata"), F.monotonically_increasing_id()).drop("_metadata")
    return ordered.repartition(spark.sparkContext.defaultParallelism)  # a file is one task; what follows is not


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    cols = raw.columns
    return _with_file_order(raw.select(*[C.column(c) for c in cols], "_metadata"), F.col("_metadata.row_index")).drop("_metadata")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Parquet-looking names are Parquet unless their footer says otherwise
    (then CSV); everything else is CSV.  Paths are checked through Hadoop's file
    system, so any scheme works.  A damaged Parquet file is an error.  A folder that
    :func:`replace_corpus` made is read in its newest version."""
    if not paths.exists(spark, path):
        raise FileNotFoundError(path)
    if L.TableLog(spark, path).exists():
        return read_corpus_table(spark, path).withColumnRenamed("row_idx", "_row_order")
    if path.lower().endswith(PARQUET_SUFFIXES) and is_parquet(spark, path):
        return read_parquet(spark, path)
    return read_csv(spark, path)


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether the first data file starts with Parquet's magic bytes."""
    head = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .filter(F.col("length") > 0).select("path").orderBy("path").limit(1).collect())
    if not head:
        return False
    p, fs = paths._fs(spark, head[0]["path"])
    stream = fs.open(p)
    try:
        return bytes(stream.read() & 0xFF for _ in range(4)) == b"PAR1"
    finally:
        stream.close()


def load_corpus(spark: SparkSession, path: str, source: str = "canonical", src_ord: int = 0) -> DataFrame:
    """S1 + S2 (+C1, C2): a canonical frame with explicit order."""
    return C.canonicalize(read_corpus(spark, path), source=source, src_ord=src_ord)


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Persist a cleaned corpus (Parquet, or gzip CSV like the reference)."""
    out = df.select(*[c for c in C.CORPUS_COLUMNS if c in df.columns])
    if fmt == "csv":
        write_csv(out, path)
    else:
        out.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """gzip CSV with a header, RFC 4180 quoting, whitespace kept as is."""
    (df.write.mode("overwrite").option("header", True).option("compression", compression)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def replace_corpus(spark: SparkSession, src: str, dest: str) -> int:
    """Load a corpus file (S1 -> S2 -> C7) as the next version of the table ``dest``; its row
    count (read back).  Files follow each other by position, for :func:`stored_emails_at`.  Readers see the old version or the new one (``table_log``)."""
    log = L.TableLog(spark, dest)
    table = C.corpus_table(load_corpus(spark, src)).select(*C.CORPUS_COLUMNS)
    version = L.replace(log, table.repartitionByRange("row_idx").sortWithinPartitions("row_idx"))
    X.build(log, "order", X.order_rows(log, SC.CORPUS, F.struct("row_idx")))
    return read_corpus_table(spark, dest, version).count()


def read_corpus_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The corpus that :func:`replace_corpus` stored, as one version has it (the newest by default)."""
    log = L.TableLog(spark, path)
    return log.read(SC.CORPUS, log.snapshot(version).segments)


def stored_emails_at(spark: SparkSession, path: str, positions: DataFrame, col: str = "pos", version: int | None = None) -> DataFrame:
    """C9 on a stored corpus: only files that hold a wanted position are opened, nothing is numbered again.
    Out-of-range and null positions give no row."""
    log = L.TableLog(spark, path)
    return X.at_positions(log, SC.CORPUS, log.snapshot(version), "row_idx", positions.select(col)).select(*C.CORPUS_COLUMNS)
