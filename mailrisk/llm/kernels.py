"""Numpy kernels over the bytes of Arrow text columns.

Texts are taken in slices of about 256 KB (or one longer text), so the memory
of the intermediate arrays does not depend on the batch.  Word hashes are 64-bit
polynomial hashes over random byte values, mixed at the end; they are equal in
every process because all constants come from :func:`splitmix`.  A polynomial modulo
2**64 cannot tell some long structured words apart whatever its base, so words above
``LONG_WORD`` bytes are hashed by xxh3 as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 18
KEPT_POWERS = 1 << 21
LONG_WORD = 64
U = np.uint64


def splitmix(n: int, seed: int) -> np.ndarray:
    """The first ``n`` values of the splitmix64 generator."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE_VALUES = splitmix(256, 0xC0FFEE)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse; very long tables are not kept."""
    out = []
    for at, base in ((0, BASE), (1, BASE_INVERSE)):
        t = _POWERS[at]
        while len(t) < n:
            t = np.concatenate((t, t * U(pow(base, len(t), 1 << 64))))
        if len(t) <= KEPT_POWERS:
            _POWERS[at] = t
        out.append(t)
    return out[0], out[1]


def letter_table(separators: set[int] | None = None, words: set[int] | None = None) -> np.ndarray:
    """Byte -> its lower-case (A-Z only) byte, 0 for bytes outside words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    for b in range(256):
        if (separators is not None and b in separators) or (words is not None and b not in words):
            t[b] = 0
    return t


#: words [^\x20\x09-\x0D]+ ; a NUL byte is a word byte there, so it stands as 1.
SPACED = letter_table(separators={0x20, *range(0x09, 0x0E)})
SPACED[0] = 1
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = letter_table(words={*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)})


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()) if pa.types.is_string(column.type) else column, "")
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def _chunk_words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = table[buf]
    inside = low != 0
    n = len(buf)
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    inner = off[(off > 0) & (off < n)]
    first[inner] = True
    first &= inside
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[inner - 1] = True
    last &= inside
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    total = np.empty(n + 1, dtype=U)
    total[0] = 0
    np.cumsum(_BYTE_VALUES[low] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return with_long(mix(h ^ (ends - starts).astype(U)), low, starts, ends), starts, ends


def with_long(h: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, those of long spans joined with a second hash of another kind."""
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] ^= U(xxhash.xxh3_64_intdigest(buf[starts[i]:ends[i]].tobytes()))
    return h


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the texts ``buf[off[i]:off[i + 1]]``.

    A text longer than a slice is taken in pieces cut after a separator, so only
    a single longer word needs more memory than that.
    """
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=U), z, z
    if len(buf) <= 2 * SLICE_BYTES or len(off) > 2:
        return _chunk_words(buf, off, table)
    parts, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + SLICE_BYTES)
        while end < len(buf):
            gaps = np.flatnonzero(table[buf[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(buf), end + SLICE_BYTES)
        h, s, e = _chunk_words(buf[at:end], np.array([0, end - at]), table)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring values (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.full(n, U(k), dtype=U)
    for j in range(k):
        out = (out ^ (out >> U(29))) * U(0x9FB21C651E98DF25) + h[j:j + n]
    return mix(out)


def doc_windows(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows inside each document, and the document of each.

    ``counts`` are the word counts of the documents, in order.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(h) < k:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    same = doc[:len(h) - k + 1] == doc[k - 1:]
    return window_hashes(h, k)[same], doc[:len(h) - k + 1][same]


def word_counts(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Words of each text, from the words' start positions."""
    return np.diff(np.searchsorted(starts, off))
