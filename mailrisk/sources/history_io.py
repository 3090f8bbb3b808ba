"""History sink and source (S6, S7) and durable deletion (H5).

Stored as Parquet with native arrays/structs (reads prune to the columns a
report needs); JSON text only at the exchange boundary (``to_wire`` /
``from_wire``).  The history is a table with atomic versions (``table_log``):
appends, deletions and compactions may run at once, and a reader sees one
version, whole.  A batch that is written again replaces itself; a job that
names no batch gets a name of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as SC
from ..operators import history as H
from . import file_index as X
from . import table_log as L

RESULT_FIELDS = [f.name for f in SC.RESULT.fields]
FILE_BYTES = 128 << 20  # aimed at by compaction


def history_records(results: DataFrame, id_col: Column | None = None, created_at: Column | None = None) -> DataFrame:
    """S6 rows from analysis results that carry the raw request fields
    (``raw_sender``, ``raw_recipient``, ``raw_subject``, ``raw_body``).

    Rows on the error path are not recorded (the request failed).  ``id`` and
    ``created_at`` default to ``uuid()`` and the current UTC time.

    The error is tested on the finished row: an always-true test of a row number, which is not
    deterministic, keeps the optimizer from pushing the test, with the url extraction it stands for, below the exchange of the emails to the
    few tasks of the scan, where it would run a second time."""
    tested = results.withColumn("error", F.when(F.monotonically_increasing_id() >= 0, F.col("error")))
    ok = tested.filter(F.col("error").isNull())
    return ok.select(
        (id_col if id_col is not None else F.expr("uuid()")).alias("id"),
        F.col("raw_sender").alias("sender"), F.col("raw_recipient").alias("recipient"),
        F.col("raw_subject").alias("subject"), F.col("raw_body").alias("body"),
        F.col("prediction").alias("classification"), "spam_risk", "confidence", "overall_risk", "reasons",
        F.struct(*[F.col(c) for c in RESULT_FIELDS]).alias("features"),
        (created_at if created_at is not None else F.current_timestamp()).cast("timestamp").alias("created_at"))


def append_history(records: DataFrame, path: str, batch_id: int | str | None = None, stream: str = "stream") -> None:
    """Add the records as one batch, replacing that batch if the table has it.

    Numbered batches belong to ``stream``; a replay of one that has been compacted, or has lost
    deleted records, changes nothing."""
    log = L.TableLog(records.sparkSession, path)
    if isinstance(batch_id, int):
        L.append(log, records, stream, batch_id)
    else:
        L.append(log, records, f"job-{uuid.uuid4().hex}" if batch_id is None else f"named-{batch_id}", 0)


def read_history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The history as one version has it, the newest by default."""
    log = L.TableLog(spark, path)
    return log.read(SC.HISTORY, log.snapshot(version).segments)


def delete_history(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """H5, durable: the next version is without the records of ``ids``; unknown ids are a no-op.

    Only segments that hold one of the ids are written again.  Records appended meanwhile stay.
    """
    log = L.TableLog(spark, path)
    wanted = ids.select("id").distinct()

    def holders(now: L.Snapshot) -> list[str]:
        rows = log.read(SC.HISTORY, now.segments).select("id", F.col("_metadata.file_path").alias("file")) if now.segments else None
        if rows is None:
            return []
        segment = F.element_at(F.split("file", "/"), -2)
        return [r[0] for r in rows.join(wanted, "id", "left_semi").select(segment).distinct().collect()]  # at most one a segment

    def rest(chosen: list[str]) -> DataFrame:
        segments = log.snapshot().segments
        kept = log.read(SC.HISTORY, chosen).join(wanted, "id", "left_anti").select(*SC.HISTORY.fieldNames())
        return newest_first_files(kept, sum(segments[s].bytes for s in chosen if s in segments))

    L.rewrite(log, "delete", holders, rest)


def newest_first_files(history: DataFrame, size: int) -> DataFrame:
    """Laid out for files of about ``FILE_BYTES`` that follow each other newest first (``size``: bytes of all).

    Finding the ranges reads ``history`` twice, so it should be stored rows, not a job."""
    order = H.newest_first()
    return history.repartitionByRange(max(1, -(-size // FILE_BYTES)), *order).sortWithinPartitions(*order)


def compact_history(spark: SparkSession, path: str, small: int = 64 << 20, at_least: int = 2) -> None:
    """Merge small batches into files sorted newest first; which batches they hold is kept, so replays still count once."""
    log = L.TableLog(spark, path)

    def arrange(chosen: list[str], size: int) -> DataFrame:
        return newest_first_files(log.read(SC.HISTORY, chosen), size)

    L.compact(log, arrange, small, at_least)


def arrange_history(spark: SparkSession, path: str) -> None:
    """Write all segments again as files that follow each other newest first, at least one a core."""
    log = L.TableLog(spark, path)
    size = sum(s.bytes for s in log.snapshot().segments.values())
    spread = max(size, spark.sparkContext.defaultParallelism * FILE_BYTES)
    L.rewrite(log, "compact", lambda now: list(now.segments), lambda chosen: newest_first_files(log.read(SC.HISTORY, chosen), spread))


def _order_key() -> Column:
    """Ascending in the order of ``newest_first``: no date last, then the id, null first."""
    return F.struct(F.col("created_at").isNull().alias("undated"), (-F.unix_micros("created_at")).alias("age"), F.col("id"))


def index_history(spark: SparkSession, path: str) -> None:
    """Bring the order and substring indexes up to the newest version; each reads new segments only."""
    log = L.TableLog(spark, path)
    X.build(log, "order", X.order_rows(log, SC.HISTORY, _order_key()))
    X.build(log, "grams", X.gram_rows(log, SC.HISTORY, H.searched_text()))


def stored_page(spark: SparkSession, path: str, offset: int, size: int, version: int | None = None) -> DataFrame:
    """H1 for one page at any depth: rows ``offset + 1`` to ``offset + size``, newest first, with their ``number``.

    Only files whose key range holds the page are opened, and those that overlap them (``compact_history``
    leaves none)."""
    log = L.TableLog(spark, path)
    return X.page(log, SC.HISTORY, log.snapshot(version), _order_key(), offset, size, H.history_list)


def stored_search(spark: SparkSession, path: str, query: str, version: int | None = None) -> DataFrame:
    """H3 on the stored history: files that cannot hold the query are not opened, the exact test follows."""
    log = L.TableLog(spark, path)
    return H.history_search(X.holding(log, SC.HISTORY, log.snapshot(version), query.lower()), query)


def to_wire(history: DataFrame) -> DataFrame:
    """History with ``reasons``/``features`` as JSON text (the exchange format)."""
    return history.withColumn("reasons", F.to_json("reasons")).withColumn("features", F.to_json("features"))


def from_wire(wire: DataFrame) -> DataFrame:
    """S7 for JSON-text history: parse the two JSON columns with fixed schemas."""
    return (wire.withColumn("reasons", F.from_json("reasons", SC.STRINGS))
            .withColumn("features", F.from_json("features", SC.RESULT)))
