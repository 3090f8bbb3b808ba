"""Exact codes of words, lines and word windows (numpy and Arrow, no hashing of identity).

Equal byte spans get equal codes by Arrow's dictionary encoding, and runs of codes get codes
by factorising pairs, so nothing here depends on a hash being free of collisions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes; no run crosses the text bounds ``off``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = off[(off > 0) & (off < n)]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_codes(buf: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Code of every span and the distinct spans; the spans are exactly the ``inside`` bytes."""
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf[inside]))])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense code of every pair ``(a[i], b[i])`` of codes."""
    if not len(a):
        return np.zeros(0, np.int64)
    return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)


def text_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of the text that each span lies in."""
    return np.searchsorted(off, starts, "right") - 1
