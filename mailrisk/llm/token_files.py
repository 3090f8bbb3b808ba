"""Token-ID output (operator 5): raw id shards with a minimal perfect hash index.

File format.  A shard is one binary file:

* the ids of its documents in ascending doc_id order, each document closed by the end
  id 0; ids are little-endian unsigned integers of 2 bytes (vocabulary up to 65,536)
  or 4 bytes, so a loader can map the file and slice it;
* a footer: doc_id (8 bytes each), ids of the document with the end id (8 bytes each),
  null flag of the doc_id (1 byte each), number of documents (8 bytes), id width
  (8 bytes), ``TOKIDS01``;
* one more end id.

Shards are written by Spark's own text writer: a row is one document's ids, and the
end id is the line separator.  So files come from the commit protocol of any store
that Spark can write, and a lost executor leaves no half shard.

Index.  Keys (doc_id, occurrence) are dealt by hash into buckets of about 2,048 keys;
each bucket is one Parquet row with a minimal perfect hash function (``mphf``) and, in
slot order, fingerprint, shard, offset and length.  A key costs one bucket, one
function and one slot, whatever the size of the corpus.

Edge cases: null text is an empty text (only the end id); a null doc_id sorts first and
is its own key; rows with the same doc_id are occurrences 0, 1, ... in text order; an
empty table gives no shard and no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mphf
from .common import map_arrow, partitions, pick, running_total, ship_code, sorted_runs, stored
from .tokens import encoder

MAGIC = b"TOKIDS01"
BUCKET_KEYS = 2_048


def write_token_files(docs: DataFrame, tokenizer: str, out: str, width: int = 2, shards: int | None = None) -> str:
    """Write the ids of every text to shards under ``out`` in ascending doc_id order."""
    dtype = {2: "<u2", 4: "<u4"}[width]

    def encode(batches):
        enc = encoder(tokenizer, dtype)
        ids, counts, nulls = [], [], []
        for b in batches:
            key = b.column(0)
            ids.append(key.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(key.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
            for _, raw in enc.groups(b.column(1)):
                counts += [len(x) // width + 1 for x in raw]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["value"])
        if counts:
            foot = b"".join([np.concatenate(ids).tobytes(), np.array(counts, "<i8").tobytes(),
                             np.concatenate(nulls).tobytes(), np.array([len(counts), width], "<i8").tobytes(), MAGIC])
            yield pa.RecordBatch.from_arrays([pa.array([foot], pa.binary())], ["value"])

    n = shards or partitions(docs.sparkSession)
    ordered = pick(docs, "doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    (map_arrow(ordered, encode, "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\0" * width).text(out))
    return out


def _open(content: memoryview):
    """``(ids, doc_id, n_tokens, is_null)`` of one shard."""
    width = next(w for w in (2, 4) if bytes(content[-w - 8:-w]) == MAGIC)
    end = len(content) - width - 8
    n, w = np.frombuffer(content, "<i8", 2, end - 16) if (end - 16) % 8 == 0 else np.frombuffer(bytes(content[end - 16:end]), "<i8")
    if w != width:
        raise ValueError("shard footer and id width differ")
    foot = end - 16 - 17 * int(n)
    raw = bytes(content[foot:end - 16])
    doc = np.frombuffer(raw, "<i8", n)
    counts = np.frombuffer(raw, "<i8", n, 8 * n)
    nulls = np.frombuffer(raw, np.uint8, n, 16 * n)
    return np.frombuffer(content, f"<u{width}", foot // width), doc, counts, nulls


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards: where it lies and the crc32 of its ids as 32-bit integers."""
    schema = "shard int, doc_id long, occurrence long, offset long, n_tokens long, ids_crc32 long"

    def digest(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                view = memoryview(content.as_buffer())
                if not len(view):
                    continue
                ids, doc, counts, nulls = _open(view)
                starts = np.cumsum(counts) - counts
                crc = [zlib.crc32(ids[a:a + c].astype("<u4").tobytes()) for a, c in zip(starts, counts, strict=True)]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (nulls[1:] != nulls[:-1])
                first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
                shard = int(re.search(r"part-(\d+)", file.rsplit("/", 1)[1])[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), shard, np.int32)), pa.array(doc, mask=nulls.astype(bool)),
                     pa.array(np.arange(len(doc)) - first), pa.array(starts.astype(np.int64)),
                     pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "occurrence", "offset", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_arrow(files, digest, schema)


def _keys(b) -> np.ndarray:
    doc = b.column("doc_id")
    doc = doc.combine_chunks() if isinstance(doc, pa.ChunkedArray) else doc
    return mphf.key_hash(doc.fill_null(0).to_numpy(zero_copy_only=False),
                         b.column("occurrence").to_numpy(), doc.is_null().to_numpy(zero_copy_only=False))


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(n)).cast("int")


def build_index(entries: DataFrame, buckets: int) -> DataFrame:
    """Index rows from ``(doc_id, occurrence, shard, offset, n_tokens)``."""
    schema = "bucket int, n int, function binary, fingerprints binary, shards binary, offsets binary, lengths binary"

    def make(batches):
        for t, bounds in sorted_runs(batches, ["bucket"]):
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                g = t.slice(a, z - a)
                keys = _keys(g)
                function, slot = mphf.build(keys)
                cols = []
                for v, kind in ((mphf.fingerprint(keys), "<u4"), (g.column("shard").to_numpy(), "<i4"),
                                (g.column("offset").to_numpy(), "<i8"), (g.column("n_tokens").to_numpy(), "<i8")):
                    out = np.empty(len(keys), kind)
                    out[slot] = v
                    cols.append(out.tobytes())
                yield pa.RecordBatch.from_pylist([dict(zip(
                    ["bucket", "n", "function", "fingerprints", "shards", "offsets", "lengths"],
                    [int(g.column("bucket")[0].as_py()), len(keys), function, *cols], strict=True))],
                    pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in
                              ("function", "fingerprints", "shards", "offsets", "lengths")]]))

    dealt = entries.select("doc_id", "occurrence", "shard", "offset", "n_tokens", _bucket(buckets).alias("bucket"))
    return map_arrow(dealt.repartition("bucket").sortWithinPartitions("bucket"), make, schema)


def lookup(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Shard, offset and length of each ``(doc_id, occurrence)``; keys that the index lacks give no row."""
    schema = "doc_id long, occurrence long, shard int, offset long, n_tokens long"

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (right.num_rows and left.num_rows):
            return pa.schema([("doc_id", pa.int64()), ("occurrence", pa.int64()), ("shard", pa.int32()),
                              ("offset", pa.int64()), ("n_tokens", pa.int64())]).empty_table()
        row = right.slice(0, 1).to_pylist()[0]
        keys = _keys(left)
        slot = mphf.lookup(row["function"], keys)
        ok = (slot >= 0) & (slot < row["n"])
        ok[ok] = np.frombuffer(row["fingerprints"], "<u4")[slot[ok]] == mphf.fingerprint(keys[ok])
        at, found = slot[ok], left.filter(pa.array(ok))
        return pa.table({"doc_id": found.column("doc_id"), "occurrence": found.column("occurrence"),
                         "shard": np.frombuffer(row["shards"], "<i4")[at], "offset": np.frombuffer(row["offsets"], "<i8")[at],
                         "n_tokens": np.frombuffer(row["lengths"], "<i8")[at]})

    ship_code(keys.sparkSession)
    keyed = keys.select(F.col("doc_id").cast("long"), F.col("occurrence").cast("long"), _bucket(buckets).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, schema)


def op5_token_files(docs: DataFrame, tokenizer: str, out: str) -> DataFrame:
    """Write shards and index of ``docs``, then read every document back through the index.

    Columns doc_id, start, n_tokens, ids_crc32; ``start`` counts the ids of all
    documents before it.  One row per input row.
    """
    spark = docs.sparkSession
    write_token_files(docs, tokenizer, f"{out}/ids")
    found = stored(read_token_files(spark, f"{out}/ids"), "token-directory")
    buckets = max(1, -(-found.count() // BUCKET_KEYS))
    index = stored(build_index(found, buckets), "token-index")
    copies = pick(docs, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    keys = copies.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("occurrence"))
    placed = lookup(keys, index, buckets)
    last = found.agg(F.max("shard")).first()[0]
    sizes = (spark.range((last if last is not None else -1) + 1).select(F.col("id").cast("int").alias("shard"))
             .join(found.groupBy("shard").agg(F.sum("n_tokens").alias("ids")), "shard", "left").fillna(0, ["ids"]))
    bases = running_total(sizes, "shard", "ids", "base").select("shard", "base")
    return (placed.join(found.select("shard", "offset", "n_tokens", "ids_crc32"), ["shard", "offset", "n_tokens"])
            .join(bases, "shard")
            .select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))
