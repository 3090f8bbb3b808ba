"""Benchmark decontamination (operator 6): a broadcast hash set of test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is 10
consecutive words of a benchmark item; a shorter item with at least one word is one
window.  Every window position of every training text is hashed, looked up in the set,
and a hit is verified on the words themselves; all words inside any occurrence are hit.
Then hit spans can be cut out of the texts, or hit documents dropped.

The set is broadcast in chunks of at most ``MAX_WINDOWS`` distinct windows, a bound that
does not depend on the benchmark's size.  Nearly always there is one chunk and a single
pass without a shuffle; a larger benchmark takes one pass a chunk over rows with a
stored row number, and the passes' spans are united per row.

Edge cases: a null text has no words; a null item_id still marks words but is no item;
repeated items and documents are handled row by row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, numbered, pick, stored, widened
from .kernels import ALNUM, U, doc_windows, text_slices, window_hashes, word_counts, words

WINDOW = 10
MAX_WINDOWS = 200_000
_HITS = "n_words long, starts array<long>, ends array<long>, items array<long>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``hash, k, words`` (joined by a space) and the item_ids that hold them."""

    def cut(batches):
        for b in batches:
            item = b.column(0)
            for lo, hi, buf, off in text_slices(b.column(1)):
                h, s, e = words(buf, off, ALNUM)
                low = ALNUM[buf]
                counts = word_counts(s, off)
                rows, first = [], 0
                for i, n in enumerate(counts.tolist()):
                    k = min(n, window)
                    mine = window_hashes(h[first:first + n], k) if k else []
                    for j, key in enumerate(mine):
                        at = range(first + j, first + j + k)
                        rows.append((int(key.view(np.int64)), k, b" ".join(low[s[w]:e[w]].tobytes() for w in at), lo + i))
                    first += n
                if rows:
                    key, k, text, row = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, pa.int64()), pa.array(k, pa.int32()), pa.array(text, pa.binary()), item.take(pa.array(row))],
                        ["hash", "k", "words", "item_id"])

    found = map_arrow(pick(benchmark, "item_id", "text"), cut, "hash long, k int, words binary, item_id long")
    return found.groupBy("hash", "k", "words").agg(F.collect_set("item_id").alias("items"))


class WindowSet:
    """Windows sorted by hash, with the lengths that occur."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["hash"] % (1 << 64))
        self.hash = np.array([r["hash"] for r in rows], dtype=np.int64).view(U)
        self.words = [bytes(r["words"]) for r in rows]
        self.items = [r["items"] for r in rows]
        self.lengths = sorted({r["k"] for r in rows})
        self.marks = np.zeros(1 << 20, dtype=bool)  # first look: low bits of the hashes that occur
        self.marks[(self.hash & U((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.marks[(h & U((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), max(0, len(self.hash) - 1))
        return maybe[self.hash[at] == h[maybe]] if len(self.hash) else maybe[:0]

    def find(self, key: np.uint64, text: bytes) -> list | None:
        """The items of the window with just these words."""
        i = int(np.searchsorted(self.hash, key))
        while i < len(self.hash) and self.hash[i] == key:
            if self.words[i] == text:
                return self.items[i]
            i += 1
        return None


def scan(docs: DataFrame, windows: list, keep: list[str], text: str) -> DataFrame:
    """Add to the ``keep`` columns: words, united hit spans (word numbers, end exclusive) and items hit."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    sent = keep if text in keep else [*keep, text]
    n_keep, place = len(keep), sent.index(text)
    schema = widened(docs, keep, _HITS)

    def look(batches):
        known = WindowSet(shared.value)
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(place)):
                h, s, e = words(buf, off, ALNUM)
                counts = word_counts(s, off)
                first = np.concatenate(([0], np.cumsum(counts)))
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set] = {}
                for k in known.lengths:
                    wh, doc = doc_windows(h, counts, k)
                    if not len(wh):
                        continue
                    # windows of a text are one run: the place in it is the word's number
                    per_doc = np.maximum(counts - k + 1, 0)
                    run = np.concatenate(([0], np.cumsum(per_doc)))
                    for i in known.hits(wh).tolist():
                        d = int(doc[i])
                        w = i - int(run[d])
                        at = range(int(first[d]) + w, int(first[d]) + w + k)
                        found = known.find(wh[i], b" ".join(ALNUM[buf[s[x]:e[x]]].tobytes() for x in at))
                        if found is not None:
                            spans.setdefault(d, []).append((w, w + k))
                            items.setdefault(d, set()).update(found)
                starts, ends = [], []
                for d in range(hi - lo):
                    merged: list[list[int]] = []
                    for a, z in sorted(spans.get(d, ())):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], z)
                        else:
                            merged.append([a, z])
                    starts.append([a for a, _ in merged])
                    ends.append([z for _, z in merged])
                many = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, hi - lo) for c in range(n_keep)], pa.array(counts.astype(np.int64)),
                     pa.array(starts, many), pa.array(ends, many), pa.array([sorted(items.get(d, ())) for d in range(hi - lo)], many)],
                    [*keep, "n_words", "starts", "ends", "items"])

    return map_arrow(docs.select(*sent), look, schema)


def _unite(batches):
    """United spans of rows whose passes were gathered in lists."""
    for b in batches:
        spans = []
        for a, z in zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for x, y in sorted(zip(a, z, strict=True)):
                if merged and x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
            spans.append(merged)
        many = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("_row"), b.column("n_words"), pa.array([[x for x, _ in m] for m in spans], many),
             pa.array([[y for _, y in m] for m in spans], many), b.column("items")],
            ["_row", "n_words", "starts", "ends", "items"])


def mark(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``scan`` of every row against the whole benchmark, however many chunks that takes."""
    kept = stored(benchmark_windows(benchmark), "bench-windows")
    chunks = max(1, -(-kept.count() // max_windows))
    if chunks == 1:
        return scan(docs, kept.collect(), keep, text)
    rows = stored(docs.select(*dict.fromkeys([*keep, text])).withColumn("_row", F.monotonically_increasing_id()), "bench-rows")
    passes = None
    for i in range(chunks):
        one = scan(rows, kept.filter(F.pmod(F.xxhash64("words"), F.lit(chunks)) == i).collect(), ["_row"], text)
        passes = one if passes is None else passes.unionByName(one)
    lists = passes.groupBy("_row").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    united = map_arrow(lists, _unite, f"_row long, {_HITS}")
    return rows.select("_row", *keep).join(united, "_row").drop("_row")


def without_spans(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All columns of ``docs``, hit spans cut out of the texts (from a span's first word to the end of its last)."""
    plain, names = numbered(docs)
    at, cells = names.index("text"), plain.columns
    marked = mark(plain, benchmark, cells, f"_{at}", max_windows)

    def cut(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, (a, z) in enumerate(zip(b.column(len(names) + 1).to_pylist(), b.column(len(names) + 2).to_pylist(), strict=True)):
                if a:
                    raw = texts[i].encode()
                    buf = np.frombuffer(raw, np.uint8)
                    _, s, e = words(buf, np.array([0, len(buf)]), ALNUM)
                    parts, last = [], 0
                    for x, y in zip(a, z, strict=True):
                        parts.append(raw[last:int(s[x])])
                        last = int(e[y - 1])
                    texts[i] = b"".join([*parts, raw[last:]]).decode()
            cols = [b.column(c) for c in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, cells)

    return map_arrow(marked, cut, plain.schema).toDF(*names)


def without_documents(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    plain, names = numbered(docs)
    marked = mark(plain, benchmark, plain.columns, f"_{names.index('text')}", max_windows)
    return marked.filter(F.size("starts") == 0).select(*plain.columns).toDF(*names)


def op6_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words, hit words and items of every document; one row a document."""
    hit = F.aggregate(F.zip_with("ends", "starts", lambda z, a: z - a), F.lit(0).cast("long"), lambda x, y: x + y)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return (mark(pick(docs, "doc_id", "text"), benchmark, ["doc_id"])
            .select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
 ks AS (SELECT DISTINCT k FROM bw),
 dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
 hits AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, g)),
 hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
 hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
