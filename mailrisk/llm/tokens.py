"""Whole texts to token ids with the tokenizers library, at scan speed.

The library's rules never join what stands on two sides of a single space or line
break between other characters.  So texts are cut there (in numpy, over the bytes of
the Arrow column), each distinct piece is encoded by the library once and remembered
under a 64-bit hash (two joined ones for long pieces), and the ids of a text are gathered
from its pieces.  Texts with any other white space, or two in a row, go to the library whole,
and so do texts with the string of an added token, which the library encodes as that token
unless ``plain_marks`` is set.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .kernels import U, _BYTE_VALUES, _powers, mix, text_slices, with_long

KEEP = 1_400_000  # distinct pieces a worker remembers (about 40 bytes each); beyond that it starts anew
GROUP_BYTES = 1 << 20
_ENCODERS: dict[tuple[str, str, bool], "Encoder"] = {}

# bytes of white space other than the space and the line feed
_ODD = np.zeros(256, dtype=bool)
_ODD[[0, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _wide_spaces(buf: np.ndarray) -> np.ndarray:
    """Positions of the first byte of every white space character beyond ASCII."""
    at = np.flatnonzero(_LEADS[buf])
    if not len(at):
        return at
    b = np.concatenate((buf, np.zeros(2, np.uint8)))
    one, two, three = b[at], b[at + 1], b[at + 2]
    return at[((one == 0xC2) & ((two == 0x85) | (two == 0xA0)))
              | ((one == 0xE1) & (two == 0x9A) & (three == 0x80))
              | ((one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)))
              | ((one == 0xE2) & (two == 0x81) & (three == 0x9F))
              | ((one == 0xE3) & (two == 0x80) & (three == 0x80))]


class Encoder:
    """Ids of texts as bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str = "<u4", plain_marks: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_marks  # their strings in a text are ordinary text then
        self.marks = [] if plain_marks else [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(dtype)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=U)  # sorted
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=self.dtype)
        self.used = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of pieces that start with a space, encoded as one text and told apart by offsets."""
        ids, sizes = [np.zeros(0, dtype=self.dtype)], [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(pieces), 4096):
            some = pieces[lo:lo + 4096]
            e = self.tok.encode("".join(some), add_special_tokens=False)
            ids.append(np.array(e.ids, dtype=self.dtype))
            ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)))
            at = np.fromiter((x for x, _ in e.offsets), dtype=np.int64, count=len(ids[-1]))
            sizes.append(np.diff(np.searchsorted(at, ends), prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        spaced = np.array([len(p) > 1 and p[0] == " " for p in pieces], dtype=bool)
        a, na = self._spaced([p for p, s in zip(pieces, spaced, strict=True) if s])
        other = self.whole([p for p, s in zip(pieces, spaced, strict=True) if not s])
        ids = np.concatenate([a, *other])
        sizes = np.concatenate([na, np.fromiter(map(len, other), dtype=np.int64, count=len(other))])
        keys = np.concatenate([keys[spaced], keys[~spaced]])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), dtype=self.dtype)))
        self.pool[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        order = np.argsort(keys)
        to = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, to, keys[order])
        self.at = np.insert(self.at, to, at[order])
        self.size = np.insert(self.size, to, sizes[order])

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of texts in which every white space is a single space or line feed."""
        n = len(buf)
        space, feed = buf == 0x20, buf == 0x0A
        cut = space | feed
        cut[1:] |= feed[:-1]
        cut[off[:-1][off[:-1] < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum(_BYTE_VALUES[buf] * power[:n], out=total[1:])
        h = with_long(mix(((total[end] - total[start]) * inverse[start]) ^ (end - start).astype(U)), buf, start, end)
        code, distinct = pd.factorize(h)
        slot = np.searchsorted(self.keys, distinct)
        hit = slot < len(self.keys)
        hit[hit] = self.keys[slot[hit]] == distinct[hit]
        if not hit.all():
            first = np.empty(len(distinct), dtype=np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            new = np.flatnonzero(~hit)
            raw = buf.tobytes()
            self._learn(distinct[new], [raw[start[i]:end[i]].decode("utf-8", "replace") for i in first[new].tolist()])
            slot = np.searchsorted(self.keys, distinct)
        piece = slot[code]
        size, at = self.size[piece], self.at[piece]
        done = np.cumsum(size)
        ids = self.pool[np.repeat(at - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]
        if len(self.keys) > KEEP:
            self._forget()
        first_piece = np.searchsorted(start, off)
        bounds = (np.concatenate(([0], done))[first_piece] * self.dtype.itemsize).tolist()
        out = ids.tobytes()
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _slice(self, buf: np.ndarray, off: np.ndarray) -> list[bytes]:
        white = _ODD[buf]
        gap = (buf == 0x20) | (buf == 0x0A)
        odd = white.copy()
        odd[1:] |= gap[1:] & gap[:-1]
        odd[_wide_spaces(buf)] = True
        docs = np.diff(off)
        where = np.searchsorted(off, np.flatnonzero(odd), "right") - 1
        # two texts that touch with white space are not odd: look again inside such texts only
        suspects = np.unique(where)
        bad = np.zeros(len(docs), dtype=bool)
        for d in suspects.tolist():
            a, z = off[d], off[d + 1]
            bad[d] = odd[a + 1:z].any() or white[a] or bool(len(_wide_spaces(buf[a:z])))
        if self.marks:
            raw = buf.tobytes().lower()
            for mark in self.marks:
                place = raw.find(mark)
                while place >= 0:
                    bad[np.searchsorted(off, place, "right") - 1] = True
                    place = raw.find(mark, place + 1)
        good = ~bad
        if not bad.any():
            return self._pieces(buf, off)
        keep = np.repeat(good, docs)
        out: list[bytes] = [b""] * len(docs)
        for i, ids in zip(np.flatnonzero(good).tolist(),
                          self._pieces(buf[keep], np.concatenate(([0], np.cumsum(docs[good])))), strict=True):
            out[i] = ids
        which = np.flatnonzero(bad).tolist()
        for i, ids in zip(which, self.whole([buf[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace") for i in which]), strict=True):
            out[i] = ids.tobytes()
        return out

    def groups(self, column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """``(first row, ids of the texts)`` for groups of rows of a text column; null is empty."""
        for lo, hi, buf, off in text_slices(column, GROUP_BYTES):
            yield lo, self._slice(buf, off) if len(buf) else [b""] * (hi - lo)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x for _, g in self.groups(pa.array(texts, pa.string())) for x in g]


def encoder(path: str, dtype: str = "<u4", plain_marks: bool = False) -> Encoder:
    """One encoder a worker and file: its memory of pieces serves all tasks of that worker."""
    if (path, dtype, plain_marks) not in _ENCODERS:
        _ENCODERS[path, dtype, plain_marks] = Encoder(path, dtype, plain_marks)
    return _ENCODERS[path, dtype, plain_marks]
