"""Quality rules (operator 11): compression bands.

A text that repeats itself compresses far better than prose of its length, and noise far
worse.  The ratio of bytes to zstandard bytes (level ``LEVEL``) is taken of the whole text
and of its fixed chunks of ``CHUNK`` bytes, each compressed alone.  What prose reaches grows
with the length, so every band of lengths (a power of two of bytes) has its own least and
largest ratio, ``LIMITS``.  A text is ``repetitive`` or ``incompressible`` when its whole
ratio leaves its band, or when more than ``BAD_SHARE`` of its chunks leave theirs on that
side.  Texts and chunks shorter than the first band say too little and are not judged.

Base counts of the contract stand beside: words ``[^\\x20\\x09-\\x0D]+`` and their code
points, symbols, repeated lines and words in repeated 8-word windows.  They are exact:
words, lines and windows are told apart by their bytes, not by a hash.

Everything is one pass over the table without a shuffle; a task holds a slice of about
256 KB of texts, or one longer text.

Edge cases: a null or empty text has no words, no ratio (null) and fails the base rules;
rows that repeat a doc_id or have none are judged alone; other columns are left behind; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick, widened
from .exact import paired, span_codes, spans, text_of
from .kernels import text_slices

LEVEL = 3
CHUNK = 4096
BAD_SHARE = 0.25
#: band (floor of log2 of bytes) -> (least ratio, largest ratio); longer texts take the last band
LIMITS = {7: (0.90, 2.60), 8: (1.05, 2.70), 9: (1.15, 2.80), 10: (1.25, 3.00), 11: (1.30, 3.20), 12: (1.35, 3.40),
          13: (1.40, 3.60), 14: (1.40, 3.80), 15: (1.45, 4.00), 16: (1.45, 4.20), 17: (1.50, 4.50)}
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[off])


def base_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for the texts ``buf[off[i]:off[i + 1]]``."""
    n = len(off) - 1
    word = _WORD[buf]
    starts, ends = spans(word, off)
    doc = text_of(starts, off)
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": _per_text(word & ((buf & 0xC0) != 0x80), off),
           "n_symbols": _per_text(_SYMBOL[buf], off)}

    in_line = buf != 0x0A
    a, z = spans(in_line, off)
    worded = np.concatenate(([0], np.cumsum(word, dtype=np.int64)))
    some = (worded[z] - worded[a]) > 0
    line_doc = text_of(a, off)
    lines = span_codes(buf, in_line, a, z)[0]
    again = pd.Series(lines * n + line_doc).duplicated().to_numpy() & some
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)

    code, size = span_codes(buf, word, starts, ends)[0], 1
    while size < WINDOW and len(code) > size:
        code, size = paired(code[:-size], code[size:]), 2 * size
    m = len(starts) - WINDOW + 1
    covered = np.zeros(len(starts) + 1, dtype=np.int64)
    if m > 0:
        at = np.flatnonzero(doc[:m] == doc[WINDOW - 1:])
        twice = at[pd.Series(code[at] * n + doc[at]).duplicated(keep=False).to_numpy()]
        covered[twice] += 1
        covered[twice + WINDOW] -= 1
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def band(size: int, limits: dict[int, tuple[float, float]]) -> tuple[float, float] | None:
    """Least and largest ratio of a text of ``size`` bytes; None below the first band."""
    k = size.bit_length() - 1
    return limits[min(k, max(limits))] if k >= min(limits) else None


def judge(raw: bytes, press: zstandard.ZstdCompressor, limits: dict[int, tuple[float, float]] = LIMITS, chunk: int = CHUNK,
          bad_share: float = BAD_SHARE) -> tuple[float | None, int, int, int, str | None]:
    """Whole ratio, chunks judged, those too compressible, those too little, and the reason to reject or None."""
    if not raw:
        return None, 0, 0, 0, None
    ratio = len(raw) / len(press.compress(raw))
    chunks = over = under = 0
    pieces = range(0, len(raw), chunk) if len(raw) > chunk else ()
    for at in pieces:
        piece = raw[at:at + chunk]
        if (span := band(len(piece), limits)) is None:
            continue
        r = len(piece) / len(press.compress(piece))
        chunks, over, under = chunks + 1, over + (r > span[1]), under + (r < span[0])
    whole = band(len(raw), limits)
    if whole is not None and (ratio > whole[1] or over > bad_share * chunks):
        reason = "repetitive"
    elif whole is not None and (ratio < whole[0] or under > bad_share * chunks):
        reason = "incompressible"
    else:
        reason = None
    return ratio, chunks, over, under, reason


def compression_rules(docs: DataFrame, keep: list[str], limits: dict[int, tuple[float, float]] = LIMITS, chunk: int = CHUNK,
                      bad_share: float = BAD_SHARE, level: int = LEVEL) -> DataFrame:
    """``keep`` columns, the base counts, the ratios and the band verdict ``reason`` (null: inside) of every text."""
    schema = widened(docs, keep, ", ".join(f"{c} long" for c in COUNTS)
                     + ", ratio double, n_chunks long, repetitive_chunks long, incompressible_chunks long, reason string")
    n_keep = len(keep)
    kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def look(batches):
        press = zstandard.ZstdCompressor(level=level)
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(n_keep)):
                counts = base_counts(buf, off)
                raw = buf.tobytes()
                found = [judge(raw[a:z], press, limits, chunk, bad_share) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(lo, hi - lo) for c in range(n_keep)], *[pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                     *[pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]], schema.names)

    return map_arrow(docs.select(*keep, F.col("text").alias("_text")), look, schema)


def op11_compression_bands(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, the bands' findings and ``kept`` of every document; one row each."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (compression_rules(pick(docs, "doc_id", "text"), ["doc_id"])
            .withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("reason").isNull()))
