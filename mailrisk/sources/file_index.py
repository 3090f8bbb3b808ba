"""Indexes of a stored table's files: which of them hold given positions, a page, or a substring.

Segments of a table never change (``table_log``), so what is known of a file stays true.  An index is a
table beside the data, one row a file or a piece of one:

    order   rows of the file, its smallest and largest order key
    grams   a bit set of the hashed three-byte sequences of the searched text

    <table>/index/<kind>/<name>/part-*.parquet    rows
    <table>/index/<kind>/<number>.json            segments it covers and the folder of its rows

Each build covers the newest version whole: the rows of segments known before are copied, new segments
are read.  A reader takes the newest index; segments it does not cover are read for their order keys,
or searched, so results never depend on when an index was built.

What comes to the driver is names of files that a query has to open, at most all of a version's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import paths
from .table_log import Snapshot, TableLog

GRAM_BITS = 1 << 18  # 32 KB a piece of a file
_MIX = np.uint32(2654435761)


def _place() -> list[Column]:
    """Segment and name of the file that a row comes from."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return [F.element_at(parts, -2).alias("segment"), F.element_at(parts, -1).alias("file")]


# -- keeping -----------------------------------------------------------------

def _newest(log: TableLog, kind: str) -> tuple[int, str | None, set[str]]:
    """Number, folder and covered segments of the newest index."""
    root = f"{log.path}/index/{kind}"
    number = max((int(f.split(".")[0]) for f in paths.files(log.spark, root) if f.endswith(".json")), default=0)
    if not number:
        return 0, None, set()
    raw = json.loads(paths.read_text(log.spark, f"{root}/{number:020d}.json") or "{}")
    return number, f"{root}/{raw['folder']}", set(raw["segments"])


def _rows(log: TableLog, kind: str, now: Snapshot, make) -> DataFrame:
    """Index rows of a version: stored ones where there are any, the others made now."""
    _, folder, covered = _newest(log, kind)
    known = [s for s in now.segments if s in covered]
    fresh = [s for s in now.segments if s not in covered]
    made = make(fresh)
    if not known:
        return made
    return log.spark.read.schema(made.schema).parquet(folder).filter(F.col("segment").isin(known)).unionByName(made)


def build(log: TableLog, kind: str, make) -> int:
    """Cover the newest version by an index; its number.  Of two builds at once one is kept, either is right."""
    now = log.snapshot()
    number, _, covered = _newest(log, kind)
    if set(now.segments) <= covered:
        return number
    name = uuid.uuid4().hex
    _rows(log, kind, now, make).write.parquet(f"{log.path}/index/{kind}/{name}")
    text = json.dumps({"folder": name, "segments": sorted(now.segments)})
    log._publish(text, f"{log.path}/index/{kind}/{number + 1:020d}.json")
    return number + 1


# -- order -------------------------------------------------------------------

def order_rows(log: TableLog, schema: T.StructType, key: Column):
    """Rows of the ``order`` index: (segment, file, rows, lo, hi), one a file; only the key's columns are read."""
    def make(segments: list[str]) -> DataFrame:
        if not segments:
            empty = log.spark.createDataFrame([], schema).select(F.lit("").alias("segment"), F.lit("").alias("file"), key.alias("key"))
        else:
            empty = log.read(schema, segments).select(*_place(), key.alias("key"))
        return empty.groupBy("segment", "file").agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return make


def strata(index: DataFrame) -> DataFrame:
    """The index with each file's stratum: files whose key ranges overlap, directly or through others,
    share one, and strata follow each other in order.  ``before`` counts the rows of earlier strata, ``size``
    those of its own.  Where files are clustered by the key a stratum is one file.  One row a file is sorted."""
    earlier = Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = index.withColumn("_starts", F.coalesce(F.max("hi").over(earlier) < F.col("lo"), F.lit(True)).cast("int"))
    numbered = starts.withColumn("stratum", F.sum("_starts").over(upto)).drop("_starts")
    sizes = numbered.groupBy("stratum").agg(F.sum("rows").alias("size"), F.min("lo").alias("first"))
    running = Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    return numbered.join(F.broadcast(sizes), "stratum")


def _open(log: TableLog, schema: T.StructType, files: list) -> DataFrame:
    names = [f"{log.folder(r['segment'])}/{r['file']}" for r in files]
    return log.spark.read.schema(schema).parquet(*names) if names else log.spark.createDataFrame([], schema)


def page(log: TableLog, schema: T.StructType, now: Snapshot, key: Column, offset: int, size: int, number) -> DataFrame:
    """Rows ``offset`` to ``offset + size - 1`` in key order with their 1-based ``number``; only the strata
    that hold them are opened.  ``number(rows)`` numbers those from 1."""
    found = strata(_rows(log, "order", now, order_rows(log, schema, key)))
    wanted = found.filter((F.col("before") < offset + size) & (F.col("before") + F.col("size") > offset)).select("segment", "file", "before").collect()
    skipped = min((r["before"] for r in wanted), default=0)
    numbered = number(_open(log, schema, wanted)).withColumn("number", F.col("number") + skipped)
    return numbered.filter((F.col("number") > offset) & (F.col("number") <= offset + size))


def at_positions(log: TableLog, schema: T.StructType, now: Snapshot, col: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``col`` is among the longs of the one-column frame ``wanted``; only files that can hold one are opened.

    The first keys of the strata (8 bytes each) go to the tasks that look the wanted values up; what comes back is strata numbers."""
    index = strata(_rows(log, "order", now, order_rows(log, schema, F.struct(F.col(col)))))
    rows = index.select("segment", "file", "stratum", F.col("first")[col].alias("first"), F.col("hi")[col].alias("hi")).orderBy("stratum").collect()
    first = {r["stratum"]: r["first"] for r in rows}
    last: dict[int, int] = {}
    for r in rows:
        last[r["stratum"]] = max(last.get(r["stratum"], r["hi"]), r["hi"])
    ids = np.array(list(first), np.int64)
    bounds = log.spark.sparkContext.broadcast((np.array([first[s] for s in first], np.int64), np.array([last[s] for s in first], np.int64), ids))

    def which(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, ids = bounds.value
        seen = np.zeros(len(ids) + 1, bool)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False)
            if len(ids) and len(v):
                at = np.searchsorted(lo, v, "right") - 1
                seen[at[(at >= 0) & (v <= hi[np.maximum(at, 0)])]] = True
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen[:-1]], pa.int64())], ["stratum"])

    wanted = wanted.select(F.col(wanted.columns[0]).cast("long").alias(col)).filter(F.col(col).isNotNull()).distinct()
    hit = {r["stratum"] for r in wanted.mapInArrow(which, "stratum long").distinct().collect()} if rows else set()
    return _open(log, schema, [r for r in rows if r["stratum"] in hit]).join(wanted, col, "left_semi")


# -- substrings --------------------------------------------------------------

def _bits(text: bytes | np.ndarray) -> np.ndarray:
    """Hashes of all three-byte sequences."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32) if isinstance(text, bytes) else text.astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * _MIX) >> np.uint32(14)).astype(np.int64)


def gram_rows(log: TableLog, schema: T.StructType, text: Column):
    """Rows of the ``grams`` index: (segment, file, bits), one a piece of a file that a task read."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, np.zeros(GRAM_BITS, bool)

        def row():
            return pa.RecordBatch.from_pylist([{"segment": at[0], "file": at[1], "bits": np.packbits(bits, bitorder="little").tobytes()}],
                                              schema=pa.schema([("segment", pa.string()), ("file", pa.string()), ("bits", pa.binary())]))

        for b in batches:
            for segment, file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (segment, file) != at:
                    if at is not None:
                        yield row()
                    at = segment, file
                    bits[:] = False
                bits[_bits(np.frombuffer(raw.as_buffer(), np.uint8))] = True
        if at is not None:
            yield row()

    def make(segments: list[str]) -> DataFrame:
        kinds = "segment string, file string, bits binary"
        if not segments:
            return log.spark.createDataFrame([], kinds)
        rows = log.read(schema, segments).select(*_place(), F.coalesce(text, F.lit("")).cast("binary").alias("t"))
        return rows.mapInArrow(mark, kinds)
    return make


def holding(log: TableLog, schema: T.StructType, now: Snapshot, needle: str) -> DataFrame:
    """The table without files that cannot hold ``needle`` (already in the form of the indexed text).

    The index has no false negatives: a text with the needle has all its three-byte sequences in one piece.
    A needle under three bytes rules nothing out."""
    _, folder, covered = _newest(log, "grams")
    known, fresh = [s for s in now.segments if s in covered], [s for s in now.segments if s not in covered]
    if not known:
        return log.read(schema, now.segments)
    fits = F.lit(True)
    for h in np.unique(_bits(needle.encode())).tolist():
        byte = F.conv(F.hex(F.substring("bits", h // 8 + 1, 1)), 16, 10).cast("int")
        fits = fits & (byte.bitwiseAND(1 << h % 8) != 0)
    rows = log.spark.read.parquet(folder).filter(F.col("segment").isin(known)).filter(fits)
    may = _open(log, schema, rows.select("segment", "file").distinct().collect())
    return may.unionByName(log.read(schema, fresh)) if fresh else may
