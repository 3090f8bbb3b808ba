"""Minimal perfect hash over 64-bit keys, with stored fingerprints (numpy).

Level by level, each key is hashed into a bit array of twice the number of keys
left; a key alone at its bit is placed there, the others go on to the next level.
The slot of a key is the number of set bits before its own over all levels.  After
``MAX_LEVELS`` the few keys left are kept as a sorted list.  A fingerprint of the
key stands in its slot, so a key that was never put in is refused (but for one in
2**32).
"""

from __future__ import annotations

import numpy as np

from .kernels import U, mix

GAMMA = 2.0
MAX_LEVELS = 24


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    """64-bit key of the ``occurrence``-th row of a document id."""
    base = mix(doc_id.astype(np.int64).view(U) + U(0x9E3779B97F4A7C15))
    return mix(base ^ mix(occurrence.astype(np.int64).view(U) * U(2) + is_null.astype(U)))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U(0x5851F42D4C957F2D)) >> U(32)).astype(np.uint32)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + U((level + 1) * 0xD1342543DE82EF95 % (1 << 64))) % U(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``(function, slot of each key)``; keys must differ."""
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two keys of one index bucket have the same 64-bit hash")
    slots = np.empty(len(keys), dtype=np.int64)
    left = np.arange(len(keys))
    sizes, arrays, used = [], [], 0
    for level in range(MAX_LEVELS):
        if not len(left):
            break
        size = max(64, int(GAMMA * len(left)) + 63) // 64 * 64
        at = _place(keys[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        fits = alone[at]
        before = np.cumsum(alone) - 1
        slots[left[fits]] = used + before[at[fits]]
        used += int(alone.sum())
        sizes.append(size)
        arrays.append(np.packbits(alone, bitorder="little"))
        left = left[~fits]
    rest = np.sort(keys[left])
    slots[left] = used + np.searchsorted(rest, keys[left])
    head = np.array([len(sizes), *sizes, len(rest)], dtype="<i8")
    return b"".join([head.tobytes(), *[a.tobytes() for a in arrays], rest.astype("<u8").tobytes()]), slots


def lookup(function: bytes, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level and no rest has it (fingerprints decide the others)."""
    n_levels = int(np.frombuffer(function, "<i8", 1)[0])
    head = np.frombuffer(function, "<i8", n_levels + 2)
    pos, used = 8 * (n_levels + 2), 0
    slots = np.full(len(keys), -1, dtype=np.int64)
    left = np.arange(len(keys))
    for level in range(n_levels):
        size = int(head[1 + level])
        bits = np.unpackbits(np.frombuffer(function, np.uint8, size // 8, pos), bitorder="little").astype(bool)
        pos += size // 8
        at = _place(keys[left], level, size)
        hit = bits[at]
        slots[left[hit]] = used + (np.cumsum(bits) - 1)[at[hit]]
        used += int(bits.sum())
        left = left[~hit]
    rest = np.frombuffer(function, "<u8", int(head[-1]), pos)
    if len(rest) and len(left):
        at = np.searchsorted(rest, keys[left])
        ok = (at < len(rest)) & (rest[np.minimum(at, len(rest) - 1)] == keys[left])
        slots[left[ok]] = used + at[ok]
    return slots
