"""Plain CSV files with newlines inside quoted cells, read by many tasks.

A byte range cannot know whether it begins inside a quoted cell, so every range is looked at under
both hypotheses: a first pass counts, for each, the quotes and record starts of the range and checks
that every quote opens or closes a cell where RFC 4180 has it.  Running sums over the ranges of a file
(one row a range) tell which hypothesis holds and how many records begin before the range.  The second
pass joins lines to records; a record that crosses ranges is put together from its pieces, at most
two a range.  Cells are then parsed by Spark's own CSV parser, one record a row.

Files that are quoted otherwise (a stray quote, an open one at the end, carriage returns as or
among the line ends) are not for this reader: :func:`read` returns ``None`` and the
caller reads them whole.  Compressed files cannot be cut and are refused as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

COMPRESSED = (".gz", ".gzip", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd")
QUOTE, COMMA, CR = 34, 44, 13

_RANGE = ("path string, start long, quotes long, lines long, ok0 boolean, ok1 boolean, records0 long, records1 long, "
          "ends0 long, ends1 long, returns0 long, returns1 long")
_PIECE = "block long, k long, part boolean, text binary"


class Lines:
    """Consecutive lines of one range: their bytes and, for each, the quotes before it."""

    def __init__(self, values: pa.Array):
        ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
        raw = values.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        self.data, self.at = whole[ends[0]:ends[-1]], ends - ends[0]
        self.quotes = np.flatnonzero(self.data == QUOTE)
        self.before = np.searchsorted(self.quotes, self.at)  # of each line's start; the last entry is the total
        size = np.diff(self.at)
        last = np.where(size > 0, self.data[np.maximum(self.at[1:] - 1, 0)], 0) if len(self.data) else np.zeros(len(size), np.uint8)
        self.ends_in_return = last == CR
        self.empty = (size == 0) | ((size == 1) & self.ends_in_return)

    def inside(self, first: int) -> np.ndarray:
        """Whether each line, and the end, is inside a quoted cell when ``first`` quotes lie before the first line."""
        return (self.before + first) % 2 == 1

    def well_placed(self) -> tuple[np.ndarray, np.ndarray]:
        """For each quote: could it open a cell (or follow an escaping one) here, could it close one."""
        line = np.searchsorted(self.at, self.quotes, side="right") - 1
        padded = np.concatenate([self.data, np.zeros(2, np.uint8)])
        previous, following = padded[np.maximum(self.quotes - 1, 0)], padded[self.quotes + 1]
        at_start = self.quotes == self.at[line]
        room = self.at[line + 1] - self.quotes - 1
        opens = at_start | (previous == COMMA) | (previous == QUOTE)
        closes = (room == 0) | (following == COMMA) | (following == QUOTE) | ((room == 1) & (following == CR))
        return opens, closes


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of rows whose keys are equal."""
    changes = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(keys[0])]
    return list(zip(cuts, cuts[1:]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: one row a range with its counts under both hypotheses."""
    current: dict | None = None
    done: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        path, start = batch.column("path").dictionary_encode(), batch.column("start").to_numpy()
        for lo, hi in _runs(path.indices.to_numpy(), start):
            key = path.dictionary[path.indices[lo].as_py()].as_py(), int(start[lo])
            if current is None or (current["path"], current["start"]) != key:
                done += [current] if current else []
                current = dict(path=key[0], start=key[1], quotes=0, lines=0, ok0=True, ok1=True, records0=0, records1=0,
                               ends0=0, ends1=0, returns0=0, returns1=0)
            lines = Lines(batch.column("value").slice(lo, hi - lo))
            opens, closes = lines.well_placed()
            order = np.arange(len(lines.quotes))
            returns = np.flatnonzero(lines.data == CR)
            quoted = np.searchsorted(lines.quotes, returns)
            ending = np.searchsorted(lines.at, returns + 1) < len(lines.at)
            ending &= lines.at[np.minimum(np.searchsorted(lines.at, returns + 1), len(lines.at) - 1)] == returns + 1
            for h in (0, 1):
                first = current["quotes"] + h
                inside = lines.inside(first)
                fits = np.where((order + first) % 2 == 0, opens, closes).all()
                outside_return = (quoted + first) % 2 == 0
                current[f"ok{h}"] &= bool(fits and not (outside_return & ~ending).any())
                current[f"records{h}"] += int((~inside[:-1] & ~lines.empty).sum())
                current[f"ends{h}"] += int((~inside[1:]).sum())
                current[f"returns{h}"] += int(outside_return.sum())
            current["quotes"] += len(lines.quotes)
            current["lines"] += hi - lo
    done += [current] if current else []
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([
            ("path", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("lines", pa.int64()), ("ok0", pa.bool_()), ("ok1", pa.bool_()),
            *[(f"{c}{h}", pa.int64()) for c in ("records", "ends", "returns") for h in (0, 1)]]))


def _pieces(edges: bool):
    """Second pass: records as (block, number in the block, whether a piece only, bytes).

    ``edges`` gives the pieces of records that cross ranges, otherwise the whole records.  Number -1 is
    the record that was open where the range begins."""
    schema = pa.schema([("block", pa.int64()), ("k", pa.int64()), ("part", pa.bool_()), ("text", pa.binary())])

    def batch_of(block, numbers, texts):
        n = len(texts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(numbers, pa.int64()), pa.array(np.full(n, edges)), texts], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, quotes, number, held, cut = None, 0, -1, [], False  # held: lines of the record that is still open

        def leave():
            """The range ends; a record still open goes on in the next one."""
            if edges and held:
                yield batch_of(block, [number], pa.array([b"\n".join(held)], pa.binary()))

        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("block").null_count:
                raise RuntimeError("the files were cut otherwise than in the first pass; set spark.sql.files.minPartitionNum")
            blocks, opened = batch.column("block").to_numpy(), batch.column("opened").to_numpy()
            for lo, hi in _runs(blocks):
                if blocks[lo] != block:
                    yield from leave()
                    block, quotes, number, held, cut = int(blocks[lo]), int(opened[lo]), -1, [], bool(opened[lo])
                values = batch.column("value").slice(lo, hi - lo)
                lines = Lines(values)
                inside = lines.inside(quotes)
                quotes += len(lines.quotes)
                kept = np.flatnonzero(inside[:-1] | ~lines.empty)  # empty lines between records are none
                if not len(kept):
                    continue
                values, within = values.take(pa.array(kept)), inside[:-1][kept]
                begins = np.flatnonzero(~within)
                head = int(begins[0]) if len(begins) else len(kept)
                if head:
                    held += values.slice(0, head).to_pylist()
                open_at_end = bool(inside[-1])
                if held and (len(begins) or not open_at_end):  # it ends here
                    if cut == edges:
                        yield batch_of(block, [number], pa.array([b"\n".join(held)], pa.binary()))
                    held, cut = [], False
                if not len(begins):
                    continue
                closed = len(begins) - open_at_end
                if closed and not edges:
                    bounds = np.append(begins, len(kept))[:closed + 1] - head
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values.slice(head)), b"\n")
                    yield batch_of(block, np.arange(number + 1, number + 1 + closed), joined)
                number += len(begins)
                if open_at_end:
                    held = values.slice(int(begins[-1])).to_pylist()
        if block is not None:
            yield from leave()

    return run


def _ranges(lines: DataFrame) -> DataFrame:
    """One row a range: its hypothesis, the records that begin before it, and what decides whether the file is fit."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    found = lines.mapInArrow(_measure, _RANGE)
    opened = found.withColumn("opened", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    pick = lambda c: F.when(F.col("opened") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(c)
    picked = opened.select("path", "start", "quotes", "opened", *[pick(c) for c in ("ok", "records", "ends", "returns")])
    return picked.withColumn("base", F.coalesce(F.sum("records").over(before), F.lit(0)))


def read(spark: SparkSession, path: str, columns: list[str], options: dict[str, str]) -> DataFrame | None:
    """Rows of all CSV files under ``path`` as strings plus ``_row_order`` (0-based; files in path
    order, rows in file order), or ``None`` if a file is compressed or not quoted as RFC 4180 has it.

    ``columns`` are the header's names in order; the first record of each file is its header.  The
    table of ranges (one row each) is checkpointed and broadcast.  Each pass must cut files alike, which Spark does
    unless files are few and the session's cores change meanwhile; that is noticed and fails.
    """
    source = spark.read.option("lineSep", "\n").text(path)
    if any(f.lower().endswith(COMPRESSED) for f in source.inputFiles()):
        return None
    ensure_checkpoint_dir(spark)
    lines = source.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"),
                          F.col("_metadata.file_block_start").alias("start"))
    ranges = _ranges(lines).checkpoint()
    files = ranges.groupBy("path").agg(
        (~F.bool_and("ok") | (F.sum("quotes") % 2 == 1) | ~F.sum("returns").isin(0) & (F.sum("returns") != F.sum("ends"))).alias("unfit"),
        (F.sum("returns") > 0).alias("crlf"), F.greatest(F.sum("records") - 1, F.lit(0)).alias("rows"))
    if files.filter("unfit").limit(1).count():
        return None
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("path", "crlf", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    blocks = (ranges.join(F.broadcast(files), "path")
              .select("path", "start", "opened", "base", "crlf", "offset", F.monotonically_increasing_id().alias("block")).checkpoint())
    tagged = lines.join(F.broadcast(blocks.select("path", "start", "block", "opened")), ["path", "start"], "left").select("value", "block", "opened")
    placed = F.broadcast(blocks.select("block", "base", "crlf", "offset", "path"))

    def located(edges: bool) -> DataFrame:
        return (tagged.mapInArrow(_pieces(edges), _PIECE).join(placed, "block")
                .withColumn("n", F.col("base") + F.col("k")).filter("n > 0"))

    crossing = (located(True).join(F.broadcast(blocks.select("block", "start")), "block").groupBy("path", "n")
                .agg(F.array_sort(F.collect_list(F.struct("start", F.col("text").cast("string").alias("text")))).alias("pieces"),
                     F.first("crlf").alias("crlf"), F.first("offset").alias("offset"))
                .select("n", "crlf", "offset", F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text")))
    records = located(False).select("n", "crlf", "offset", F.col("text").cast("string").alias("text")).unionByName(crossing)
    # the whole-file reader gives every line end of a CRLF file as a newline, those inside cells too
    text = F.when(F.col("crlf"), F.rtrim(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"))).otherwise(F.col("text"))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))])
    cells = F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), {**options, "lineSep": "\n"})
    return (records.select(cells.alias("_r"), (F.col("offset") + F.col("n") - 1).alias("_row_order"))
            .select(*[F.col(f"_r.c{i}").alias(c) for i, c in enumerate(columns)], "_row_order"))
