"""Toxicity (operator 9): FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the hashes of its words (letters, digits and bytes from 0x80,
A-Z lower-cased), of neighbouring word pairs and of pairs with one word between, each
present or not.  FTRL-proximal keeps a learning rate per coordinate and drives weights
of features without evidence to exactly zero, so what is broadcast is a short list of
(feature, weight).  It is fitted in numpy on at most about ``PER_CLASS`` labelled
documents of either label.  A fifth of them is kept back: on it, weighted to the labels'
true proportion, a scale and an intercept of the score are fitted (Platt's method); the weights are then
fitted again on the whole sample.

Edge cases: a null or empty text scores by the intercept; with one label value only, or
none, every score is that label's share (0.0 without labels); a null doc_id is never
held out; repeated label rows of a document count as often as they stand; of several texts
of a doc_id one is learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, map_arrow, pick, stored, widened
from .kernels import ALNUM, U, mix, text_slices, word_counts, words
from .sampling import bound, class_counts, sample_by_class

BITS = 20
PER_CLASS = 3000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 0.0


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and text number of every word, word pair and skip pair of a slice."""
    h, s, _ = words(buf, off, ALNUM)
    doc = np.repeat(np.arange(len(off) - 1), word_counts(s, off))
    found, docs = [h], [doc]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = mix(h[:-gap] * U(0x9E3779B97F4A7C15) + (h[gap:] ^ U(gap * 0x632BE59BD9B4E019)))
            found.append(pair[same])
            docs.append(doc[:-gap][same])
    return (np.concatenate(found) >> U(64 - BITS)).astype(np.int64), np.concatenate(docs)


def _vectors(batches):
    for b in batches:
        for lo, hi, buf, off in text_slices(b.column(1)):
            f, doc = features(buf, off)
            key = np.unique((doc << BITS) + f)
            cut = np.searchsorted(key, np.arange(hi - lo + 1) << BITS)
            ids = (key & ((1 << BITS) - 1)).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array([ids[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                ["doc_id", "ids"])


def ftrl(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero features, their weights, and the intercept (coordinate 2**BITS, without L1)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        slack = np.where(at == size - 1, 0.0, L1)
        zz = z[at]
        return np.where(np.abs(zz) <= slack, 0.0, -(zz - np.sign(zz) * slack) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    data = [(y, np.append(ids, size - 1)) for y, ids in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            y, at = data[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / ALPHA * w
    every = np.flatnonzero(np.abs(z[:-1]) > L1)
    return every, weights(every), float(weights(np.array([size - 1]))[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Model from labelled rows; ``labels`` has ``doc_id, label`` with label 0 or 1."""
    counts = class_counts(labels, "label")
    total = sum(counts.values())
    if len(counts) < 2:
        p = float(next(iter(counts), 0))
        return {"ids": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 35.0 if p else -35.0}
    chosen = sample_by_class(labels, "label", counts, per_class).limit(bound(counts, per_class))  # at most 4 x per_class ids: small enough to broadcast
    chosen = stored(chosen, "toxic-sample")
    vectors = map_arrow(pick(docs, "doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").select("doc_id", "text"),
                        _vectors, "doc_id long, ids binary")
    one = vectors.groupBy("doc_id").agg(F.min("ids").alias("ids"))  # one text an id, so the sample's bound holds where ids repeat
    rows = one.join(F.broadcast(chosen), "doc_id").select("label", "ids").toArrow().to_pylist()
    data = [(y, np.frombuffer(x, "<i4").astype(np.int64)) for y, x in sorted((r["label"], r["ids"]) for r in rows)]
    back, learn = data[::5], [d for i, d in enumerate(data) if i % 5]
    ids, w, bias = ftrl(learn)
    dense = np.zeros(1 << BITS)
    dense[ids] = w
    y = np.array([d[0] for d in back], dtype=np.float64)
    share = np.where(y == 1, counts[1] / total / max(1, y.sum()), counts[0] / total / max(1, (1 - y).sum())) * len(y)
    scale, shift = platt(np.array([dense[x].sum() + bias for _, x in back]), y, share)
    ids, w, bias = ftrl(data)
    return {"ids": ids, "weights": w * scale, "bias": bias * scale + shift}


def platt(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of scores ``s`` with the least weighted log loss against smoothed labels."""
    ones, zeros = y.sum(), len(y) - y.sum()
    if not (ones and zeros):
        return 1.0, 0.0
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([s, np.ones(len(s))], axis=1)
    spread = max(float(s.std()), 1e-6)
    x[:, 0] /= spread
    beta = np.array([1.0, 0.0])

    def loss(v):
        z = x @ v
        return (weight * (np.logaddexp(0, z) - target * z)).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)))
        rate = 1.0
        while rate > 1e-6 and loss(beta - rate * step) > loss(beta):
            rate /= 2
        beta = beta - rate * step
        if rate * np.abs(step).max() < 1e-9:
            break
    return (float(beta[0] / spread), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` columns and the score of every whole text."""
    schema = widened(docs, keep, "score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_keep = len(keep)

    def look(batches):
        m = shared.value
        weight = np.zeros(1 << BITS, dtype=np.float32)
        weight[m["ids"]] = m["weights"]
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(n_keep)):
                f, doc = features(buf, off)
                hot = np.flatnonzero(weight[f])
                key = np.unique((doc[hot] << BITS) + f[hot])  # a feature counts once in a text
                sums = np.bincount(key >> BITS, weights=weight[key & ((1 << BITS) - 1)], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, hi - lo) for c in range(n_keep)], pa.array(1 / (1 + np.exp(-np.clip(sums + m["bias"], -35, 35))))],
                    [*keep, "score"])

    return map_arrow(docs.select(*keep, F.col("text").alias("_text")), look, schema)


def held_out():
    return F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 0, F.lit(False))


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents that are not held out, score all; one row a document."""
    known = pick(labels, "doc_id", "toxic").select("doc_id", F.col("toxic").cast("int").alias("label")).filter(~held_out() & F.col("label").isin(0, 1))
    return score(pick(docs, "doc_id", "text"), fit(docs, known), ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
