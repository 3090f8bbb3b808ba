"""Quality (operator 10): regularised quadratic discriminant over document statistics.

Every text gives one row of statistics: shares of upper-case, digit, punctuation,
symbol and non-ASCII bytes, word lengths, repeated words, word pairs and lines, words
with symbols or without letters, words in capitals.  A share k of n enters as
``log((k + a) / (n - k + b))`` with a prior of ``PRIOR`` observations at the share that
clean prose has, so short texts lie near the middle instead of far out.

Each label has a Gaussian over these rows.  Its mean and covariance come from sums over
ALL labelled rows, added up by Spark; covariances are shrunk towards the pooled one and
then towards a multiple of the identity.  A score is the logistic of the difference of
the Mahalanobis log-densities (plus log prior), each taken with its cached Cholesky
factor.

Edge cases: a null text is an empty one, whose statistics are the priors; with one
label value only, or none, every score is that label's share (1.0 without labels);
a null doc_id is never held out; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, map_arrow, numbered, pick, stored, widened
from .kernels import SPACED, U, letter_table, mix, text_slices, word_counts, words

#: statistic -> the share that stands in for ``PRIOR`` unseen observations
STATISTICS = {
    "upper": 0.04, "digits": 0.01, "punctuation": 0.04, "symbols": 0.002, "non_ascii": 0.03, "long_words": 0.10,
    "short_words": 0.25, "one_byte_words": 0.03, "symbol_words": 0.005, "wordless": 0.005, "capital_words": 0.01,
    "title_words": 0.12, "repeats": 0.005, "repeats_two": 0.005, "known_words": 0.30, "known_pairs": 0.05,
    "known_lines": 0.02, "ends": 0.10, "commas": 0.08, "marks": 0.003,
}
NAMES = [*STATISTICS, "word_length", "line_words"]
PRIOR = 8.0
SHRINK_POOLED = 0.05
SHRINK_DIAGONAL = 0.02
ACCEPT = 0.3

_LINES = letter_table(separators={0x0A})
_LINES[0] = 1
_KIND = {name: np.zeros(256, dtype=bool) for name in ("upper", "lower", "digit", "punct", "symbol", "wide", "end", "comma", "mark")}
_KIND["upper"][65:91] = True
_KIND["lower"][97:123] = True
_KIND["digit"][48:58] = True
_KIND["wide"][128:] = True
_KIND["punct"][[ord(c) for c in ".,;:!?'\"()-"]] = True
_KIND["symbol"][33:127] = True
for _k in ("upper", "lower", "digit", "punct"):
    _KIND["symbol"] &= ~_KIND[_k]
_KIND["end"][[ord(c) for c in ".!?"]] = True
_KIND["comma"][[ord(c) for c in ",;:"]] = True
_KIND["mark"][[ord(c) for c in "!?"]] = True


def _seen_before(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Values of each text that stand earlier in it too."""
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    again = (hs[1:] == hs[:-1]) & (ds[1:] == ds[:-1])
    return np.bincount(ds[1:][again], minlength=n)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics of the texts of a slice, one row each in the order of ``NAMES``."""
    n = len(off) - 1
    h, s, e = words(buf, off, SPACED)
    per = word_counts(s, off)
    doc = np.repeat(np.arange(n), per)
    total = per.astype(np.float64)
    sums = {k: np.concatenate(([0], np.cumsum(t[buf]))) for k, t in _KIND.items()}
    whole = {k: np.diff(v[off]).astype(np.float64) for k, v in sums.items()}
    inword = {k: v[e] - v[s] for k, v in sums.items()}
    size = e - s
    letters = inword["upper"] + inword["lower"] + inword["wide"]
    by = lambda mask: np.bincount(doc[mask], minlength=n).astype(np.float64)
    solid = np.diff(np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per)))]).astype(np.float64)
    alphabet = whole["upper"] + whole["lower"] + whole["wide"]

    same = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    repeat = np.zeros(len(h), dtype=bool)
    repeat[1:] = same & (h[1:] == h[:-1])
    repeat_two = np.zeros(len(h), dtype=bool)
    if len(h) > 2:
        repeat_two[2:] = (doc[2:] == doc[:-2]) & (h[2:] == h[:-2])
    pairs = mix(h[1:] + h[:-1] * U(0x9E3779B97F4A7C15))[same] if len(h) > 1 else np.zeros(0, U)
    pair_doc = doc[1:][same] if len(h) > 1 else np.zeros(0, np.int64)
    lh, ls, _ = words(buf, off, _LINES)
    lines = word_counts(ls, off)
    line_doc = np.repeat(np.arange(n), lines)

    shares = {
        "upper": (whole["upper"], alphabet), "digits": (whole["digit"], solid), "punctuation": (whole["punct"], solid),
        "symbols": (whole["symbol"], solid), "non_ascii": (whole["wide"], solid),
        "long_words": (by(size > 12), total), "short_words": (by(size <= 2), total), "one_byte_words": (by(size == 1), total),
        "symbol_words": (by(inword["symbol"] > 0), total), "wordless": (by(letters == 0), total),
        "capital_words": (by((inword["upper"] >= 2) & (inword["lower"] == 0)), total),
        "title_words": (by(_KIND["upper"][buf[s]] if len(s) else np.zeros(0, bool)), total),
        "repeats": (by(repeat), total), "repeats_two": (by(repeat_two), total), "known_words": (_seen_before(h, doc, n).astype(float), total),
        "known_pairs": (_seen_before(pairs, pair_doc, n).astype(float), np.maximum(total - 1, 0)),
        "known_lines": (_seen_before(lh, line_doc, n).astype(float), lines.astype(float)),
        "ends": (whole["end"], total), "commas": (whole["comma"], total), "marks": (whole["mark"], total),
    }
    out = np.empty((n, len(NAMES)))
    for j, (name, prior) in enumerate(STATISTICS.items()):
        k, m = shares[name]
        k = np.minimum(k, m)
        out[:, j] = np.log((k + PRIOR * prior) / (m - k + PRIOR * (1 - prior)))
    out[:, -2] = np.log((solid + PRIOR * 5) / (total + PRIOR))
    out[:, -1] = np.log((total + PRIOR * 15) / (lines + PRIOR))
    return out


def describe(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``x``, the statistics of each whole text as doubles."""
    schema = widened(docs, keep, "x array<double>")
    sent = keep if text in keep else [*keep, text]
    n_keep, at = len(keep), sent.index(text)

    def look(batches):
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(at)):
                x = statistics(buf, off)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in range(n_keep)], rows], [*keep, "x"])

    return map_arrow(docs.select(*sent), look, schema)


def _moments(batches):
    """Sums for mean and covariance of each label over a partition, one row a matrix cell."""
    k = len(NAMES) + 1
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        x = np.ones((b.num_rows, k))
        x[:, :-1] = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
        y = b.column("label").to_numpy()
        for label in np.unique(y).tolist():
            part = x[y == label]
            sums[label] = sums.get(label, 0) + part.T @ part
    for label, m in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(k * k, label, np.int32)), pa.array(np.arange(k * k, dtype=np.int32)), pa.array(m.ravel())], ["label", "cell", "v"])


def fit(described: DataFrame) -> dict:
    """Model from ``x, label``: a Gaussian of each label, from sums over all rows."""
    k = len(NAMES) + 1
    cells = map_arrow(described.select("label", "x"), _moments, "label int, cell int, v double")
    m = {0: np.zeros(k * k), 1: np.zeros(k * k)}
    for r in cells.groupBy("label", "cell").agg(F.sum("v").alias("v")).collect():  # 2 x k x k sums
        m[r["label"]][r["cell"]] = r["v"]
    m = {y: v.reshape(k, k) for y, v in m.items()}
    counts = {y: v[-1, -1] for y, v in m.items()}
    total = sum(counts.values())
    if min(counts.values()) < 2:
        return {"constant": 1.0 if not total else counts[1] / total}
    means = {y: v[-1, :-1] / counts[y] for y, v in m.items()}
    covs = {y: v[:-1, :-1] / counts[y] - np.outer(means[y], means[y]) for y, v in m.items()}
    pooled = sum(covs[y] * counts[y] for y in covs) / total
    out = {"constant": None, "means": means, "factors": {}, "offsets": {}}
    for y in (0, 1):
        few = len(NAMES) / (len(NAMES) + counts[y])  # fewer rows than needed for a full matrix: lean on the pooled one
        a = min(1.0, SHRINK_POOLED + few)
        c = (1 - a) * covs[y] + a * pooled
        c = (1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.trace(c) / len(NAMES) * np.eye(len(NAMES)) + 1e-9 * np.eye(len(NAMES))
        low = np.linalg.cholesky(c)
        out["factors"][y] = np.linalg.inv(low)
        out["offsets"][y] = np.log(counts[y] / total) - np.log(np.diag(low)).sum()
    return out


def log_odds(x: np.ndarray, model: dict) -> np.ndarray:
    d = {}
    for y in (0, 1):
        r = (x - model["means"][y]) @ model["factors"][y].T
        d[y] = model["offsets"][y] - 0.5 * (r * r).sum(axis=1)
    return d[1] - d[0]


def score(described: DataFrame, model: dict) -> DataFrame:
    """All columns but ``x``, and the score."""
    keep = [c for c in described.columns if c != "x"]
    shared = described.sparkSession.sparkContext.broadcast(model)

    def look(batches):
        m = shared.value
        for b in batches:
            if m["constant"] is not None:
                p = np.full(b.num_rows, float(m["constant"]))
            else:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, len(NAMES))
                p = 1 / (1 + np.exp(-np.clip(log_odds(x, m), -35, 35)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p)], [*keep, "score"])

    return map_arrow(described.select(*keep, "x"), look, widened(described, keep, "score double"))


def held_out():
    return F.coalesce(F.pmod(crc32_of_id(), F.lit(5)) == 0, F.lit(False))


def labelled(described: DataFrame, labels: DataFrame) -> DataFrame:
    known = pick(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("label")).filter(~held_out() & F.col("label").isin(0, 1))
    return described.join(known, "doc_id")


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents that are not held out, score all; one row a document."""
    described = stored(describe(pick(docs, "doc_id", "text"), ["doc_id"]), "quality-statistics")
    return score(described, fit(labelled(described, labels))).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns."""
    model = fit(labelled(describe(pick(docs, "doc_id", "text"), ["doc_id"]), labels))
    plain, names = numbered(docs)
    judged = score(describe(plain, plain.columns, f"_{names.index('text')}"), model)
    return judged.filter(F.col("score") >= ACCEPT).select(*plain.columns).toDF(*names)
