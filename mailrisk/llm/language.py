"""Language identification (operator 2): averaged hashed subword embeddings, linear softmax.

A text's subwords are the 2- to 4-byte runs of its letter bytes (A-Z lower-cased, every
other ASCII byte a word boundary, one boundary allowed at either end), hashed into
``BUCKETS`` rows of an embedding table.  A text is the mean of its subwords' embeddings;
a linear softmax turns it into language probabilities.  Both are trained by stochastic
gradient descent in numpy on at most about ``PER_CLASS`` documents of each language.  A
fifth of the sample is kept back: on it a temperature is fitted (least log loss), and the
rejection threshold is the highest score that keeps all but ``FALSE_REJECTS`` of its
rightly recognised documents, at most 0.5.

At most 2 x PER_CLASS x languages vectors of at most BUCKETS entries reach the driver;
what goes to the tasks is one table of BUCKETS x min(DIM, languages) floats.

Edge cases: a null text or one without a letter is ``und`` with score 0; without any
labelled row every text is ``und``; one learned language is always predicted; repeated
rows are scored alike; a null doc_id is never held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, map_arrow, numbered, pick, widened
from .kernels import U, mix, text_slices
from .sampling import bound, class_counts, sample_by_class

BITS = 15  # at most 16: ids travel in two bytes
BUCKETS = 1 << BITS
ORDERS = (2, 3, 4)
DIM = 16
PER_CLASS = 1200
EPOCHS = 5
RATE = 0.5
FALSE_REJECTS = 0.001
UND = "und"

_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def subwords(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every subword of the texts of a slice."""
    n_docs = len(off) - 1
    low = np.insert(_LETTERS[buf], off, 0)  # a boundary before each text and after the last
    doc = np.searchsorted(off + np.arange(n_docs + 1), np.arange(len(low)), "right") - 1
    edge = low == 0
    wide = low.astype(U)
    buckets, docs = [], []
    value = wide.copy()
    inner = np.zeros(len(low), dtype=bool)  # a boundary strictly inside the run
    for n in range(2, max(ORDERS) + 1):
        m = len(low) - n + 1
        if m <= 0:
            break
        inner = inner[:m] | edge[n - 2:n - 2 + m] if n > 2 else np.zeros(m, dtype=bool)
        value = (value[:m] << U(8)) | wide[n - 1:n - 1 + m]
        if n in ORDERS:
            ok = np.flatnonzero(~inner & ~(edge[:m] & edge[n - 1:n - 1 + m]))
            buckets.append((mix(value[ok] + U(n * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - BITS)).astype(np.int32))
            docs.append(doc[ok])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(docs)


def _vectors(batches):
    """Distinct buckets and counts of every text."""
    for b in batches:
        for lo, hi, buf, off in text_slices(b.column(1)):
            bucket, doc = subwords(buf, off)
            key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(key, np.arange(hi - lo + 1) * BUCKETS)
            ids, c = (key % BUCKETS).astype("<u2"), count.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                 *[pa.array([x[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (ids, c)]],
                ["part", "lang", "ids", "counts"])


def train(rows: list[tuple[int, bytes, bytes]], n_classes: int, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0):
    """Embedding table, softmax weights and bias from ``(class, bucket ids, counts)``."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weight = np.zeros((DIM, n_classes), dtype=np.float32)
    bias = np.zeros(n_classes, dtype=np.float32)
    docs = []
    for y, ids, counts in rows:
        c = np.frombuffer(counts, "<i4").astype(np.float32)
        if len(c):
            docs.append((y, np.frombuffer(ids, "<u2"), c / c.sum()))
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            y, ids, share = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            h = share @ table[ids]
            z = h @ weight + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            back = weight @ g
            weight -= lr * np.outer(h, g)
            bias -= lr * g
            table[ids] -= lr * share[:, None] * back[None, :] * len(ids) ** 0.5
    return table, weight, bias


def _logits(rows, table, weight, bias):
    out = np.tile(bias.astype(np.float64), (len(rows), 1))
    for i, (_, ids, counts) in enumerate(rows):
        c = np.frombuffer(counts, "<i4").astype(np.float64)
        if len(c):
            out[i] += ((c / c.sum()) @ table[np.frombuffer(ids, "<u2")]) @ weight
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale of the logits with the least log loss, and the rejection threshold at that scale."""
    if not len(y):
        return 1.0, 0.0
    scales = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    losses = [-np.log(np.maximum(_softmax(logits * s)[np.arange(len(y)), y], 1e-12)).mean() for s in scales]
    scale = float(scales[int(np.argmin(losses))])
    p = _softmax(logits * scale)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return scale, float(min(0.5, np.quantile(right, FALSE_REJECTS))) if len(right) else 0.0


def fit(labelled: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Model from rows with ``doc_id, text, lang`` (lang not null)."""
    rows = pick(labelled, "doc_id", "text", "lang")
    counts = class_counts(rows.select("lang"), "lang")
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "table": None, "threshold": 0.0}
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).cast("int")
    vectors = map_arrow(sample_by_class(rows, "lang", counts, per_class).select(part.alias("part"), "text", "lang"),
                        _vectors, "part int, lang string, ids binary, counts binary").limit(bound(counts, per_class)).toArrow().to_pylist()
    number = {v: i for i, v in enumerate(langs)}
    data = [(number[r["lang"]], r["ids"], r["counts"], r["part"]) for r in sorted(vectors, key=lambda r: (r["lang"], r["ids"], r["counts"]))]
    table, weight, bias = train([d[:3] for d in data if d[3]] or [d[:3] for d in data], len(langs))
    kept_back = [d[:3] for d in data if not d[3]] or [d[:3] for d in data]
    del vectors
    pa.default_memory_pool().release_unused()
    scale, threshold = calibrate(_logits(kept_back, table, weight, bias), np.array([d[0] for d in kept_back]))
    if len(langs) <= DIM:  # averaging and the softmax weights are both linear: one table does both
        table, weight = table @ weight, np.eye(len(langs), dtype=np.float32)
    return {"langs": langs, "table": (table * scale).astype(np.float32), "weight": weight, "bias": bias * scale, "threshold": threshold}


def predict(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score and rejected (``und``, or a score under the threshold)."""
    schema = widened(docs, keep, "lang_pred string, score double, rejected boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = keep if text in keep else [*keep, text]
    n_keep, at = len(keep), sent.index(text)

    def look(batches):
        m = shared.value
        names = np.array([*m["langs"], UND], dtype=object)
        for b in batches:
            letters = b.column(len(sent)).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in text_slices(b.column(at)):
                n = hi - lo
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if m["langs"]:
                    bucket, doc = subwords(buf, off)
                    total = np.maximum(np.bincount(doc, minlength=n), 1)
                    rows = m["table"][bucket]
                    mean = np.stack([np.bincount(doc, weights=rows[:, j], minlength=n) / total for j in range(rows.shape[1])], axis=1)
                    p = _softmax(mean @ m["weight"].astype(np.float64) + m["bias"])
                    ok = letters[lo:hi]
                    best[ok], score[ok] = p.argmax(axis=1)[ok], p.max(axis=1)[ok]
                found = names[best]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, n) for c in range(n_keep)], pa.array(found.tolist(), pa.string()), pa.array(score),
                     pa.array((best == len(names) - 1) | (score < m["threshold"]))],
                    [*keep, "lang_pred", "score", "rejected"])

    return map_arrow(docs.select(*sent, F.col(text).rlike("\\p{L}").alias("_letters")), look, schema)


def held_out():
    return F.coalesce(F.pmod(crc32_of_id(), F.lit(4)) == 2, F.lit(False))


def op2_language(docs: DataFrame) -> DataFrame:
    """Learn from documents that are not held out, predict all; one row a document."""
    docs = pick(docs, "doc_id", "text", "lang")
    model = fit(docs.filter(~held_out() & F.col("lang").isNotNull()))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def keep_recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their own columns."""
    known = pick(docs, "doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull())
    plain, names = numbered(docs)
    judged = predict(plain, fit(known), plain.columns, f"_{names.index('text')}")
    return judged.filter("NOT rejected").select(*plain.columns).toDF(*names)
