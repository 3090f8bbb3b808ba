"""Chat formatting (operator 1): columnar byte assembly of whole conversations.

Template.  A turn is ``<|im_start|>role`` + newline + text + ``<|im_end|>`` + newline.
Control strings inside roles and texts are escaped reversibly: ``<`` or ``[`` followed by
n backslashes and the rest of a control string gets one backslash more, so no control
string is left, other text is untouched, and taking one backslash away restores it.
A role also has its backslashes doubled and its line breaks written as ``\\n``.

Method.  Rows are range-partitioned and sorted by conversation and turn, so even one
conversation with a third of all rows is spread over tasks.  Each task takes slices of
a few megabytes; the lengths of header, content and footer segments give cumulative
offsets and scatter indices in numpy, and all bytes are copied into one preallocated
Arrow buffer that becomes the output column.  The loss mask is the list of code point
spans of assistant texts.

Output: one row per part (conv_id, part, n_turns, formatted, loss_starts, loss_lengths,
edge).  Parts of a conversation in order of ``part`` make its text.  Only the first and
last conversation of a slice can have several parts (``edge``).

Edge cases: null or empty text and null role are empty; rows with the same turn go by
role and text; a null turn sorts first; rows with a null conv_id are one conversation;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, partitions, pick, stored

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LOSS_ROLE = "assistant"
SLICE = 4 << 20  # bytes of text assembled at once, or one longer text
LONG = 1 << 16  # contents from this length on are copied as one slice, not by index

_TAILS = {h: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == h) for h in "<["}
_PART_SCHEMA = "conv_id long, part long, n_turns long, formatted string, loss_starts array<long>, loss_lengths array<long>, edge boolean"


def escape_column(column: pa.Array) -> pa.Array:
    for head, tails in _TAILS.items():
        column = pc.replace_substring_regex(column, pattern=rf"({re.escape(head)})(\\*)({tails})", replacement=r"\1\\\2\3")
    return column


def unescape(text: str) -> str:
    if "\\" in text:
        for head, tails in _TAILS.items():
            text = re.sub(rf"({re.escape(head)})\\(\\*)({tails})", r"\1\2\3", text)
    return text


def escape_role(role: str) -> str:
    return escape_column(pa.array([role.replace("\\", "\\\\").replace("\n", "\\n")]))[0].as_py()


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def assemble(role: pa.Array, text: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; byte offsets of the turns (n + 1), starts and ends of their contents."""
    content = escape_column(text)
    n = len(content)
    roles = role.dictionary_encode()
    heads = [f"{START}{escape_role(r)}\n".encode() for r in roles.dictionary.to_pylist()]
    foot = f"{END}\n".encode()
    which = roles.indices.to_numpy()
    head_len = np.array([len(h) for h in heads], dtype=np.int64)
    off = np.frombuffer(content.buffers()[1], dtype=np.int64)[content.offset:content.offset + n + 1]
    data = np.frombuffer(content.buffers()[2], dtype=np.uint8) if content.buffers()[2] is not None else np.zeros(0, np.uint8)

    lengths = np.empty((n, 3), dtype=np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = head_len[which], np.diff(off), len(foot)
    ends = np.cumsum(lengths.ravel()).reshape(n, 3)
    total = int(ends[-1, 2]) if n else 0
    starts = ends - lengths
    buf = pa.allocate_buffer(total)
    out = np.frombuffer(buf, dtype=np.uint8)

    def scatter(source: np.ndarray, at: np.ndarray, size: np.ndarray, to: np.ndarray) -> None:
        before = np.cumsum(size) - size
        i = np.arange(int(size.sum()))
        out[np.repeat(to - before, size) + i] = source[np.repeat(at - before, size) + i]

    pool = np.frombuffer(b"".join([*heads, foot]), dtype=np.uint8)
    head_at = np.cumsum(head_len) - head_len
    scatter(pool, head_at[which], lengths[:, 0], starts[:, 0])
    scatter(pool, np.full(n, len(pool) - len(foot)), lengths[:, 2], starts[:, 2])
    short = lengths[:, 1] < LONG
    scatter(data, off[:-1][short], lengths[short, 1], starts[short, 1])
    for i in np.flatnonzero(~short):
        out[starts[i, 1]:ends[i, 1]] = data[off[i]:off[i + 1]]
    return buf, np.concatenate((starts[:, 0], [total])), starts[:, 1], ends[:, 1]


def _format(batches):
    base, part = TaskContext.get().partitionId() << 33, 0
    for b in batches:
        text = pc.fill_null(b.column("text").cast(pa.large_string()), "")
        role = pc.fill_null(b.column("role"), "")
        conv = b.column("conv_id")
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        filled = np.concatenate(([0], np.cumsum(sizes)))
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(filled, filled[lo] + SLICE, "right")) - 1)
            yield _slice(conv.slice(lo, hi - lo), role.slice(lo, hi - lo), text.slice(lo, hi - lo), base + part)
            part += hi - lo
            lo = hi


def _slice(conv: pa.Array, role: pa.Array, text: pa.Array, part: int) -> pa.RecordBatch:
    n = len(conv)
    buf, turn_at, start, end = assemble(role, text)
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(n, dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    first = np.flatnonzero(new)
    row_part = np.cumsum(new) - 1
    bounds = turn_at[np.concatenate((first, [n]))]
    out = np.frombuffer(buf, dtype=np.uint8)
    chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    loss = np.flatnonzero(pc.equal(role, LOSS_ROLE).to_numpy(zero_copy_only=False))
    loss_off = pa.array(np.searchsorted(row_part[loss], np.arange(len(first) + 1)).astype(np.int32))
    edge = np.zeros(len(first), dtype=bool)
    edge[[0, -1]] = True
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), buf).cast(pa.string())
    spans = [pa.array(chars[start[loss]] - chars[bounds[row_part[loss]]]), pa.array(chars[end[loss]] - chars[start[loss]])]
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(part + np.arange(len(first))), pa.array(np.bincount(row_part)), formatted,
         *[pa.ListArray.from_arrays(loss_off, x) for x in spans], pa.array(edge)],
        ["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_lengths", "edge"])


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted parts of all conversations (see the module's description)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    ordered = (rows.repartitionByRange(partitions(rows.sparkSession), "conv_id", "turn")
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    return map_arrow(ordered, _format, _PART_SCHEMA)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    turns = []
    for turn in formatted.split(f"{END}\n")[:-1]:
        role, text = turn[len(START):].split("\n", 1)
        turns.append((unescape_role(role), unescape(text)))
    return turns


_DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    """Digests of conversations from their parts, which stand together and in order."""
    state = None
    names = [c.split()[0] for c in _DIGEST_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def close(s):
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    for b in batches:
        done = []
        for conv, formatted, at, size in zip(*[b.column(c) for c in ("conv_id", "formatted", "loss_starts", "loss_lengths")], strict=True):
            conv, formatted = conv.as_py(), formatted.as_py()
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(close(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for a, n in zip(at.as_py(), size.as_py(), strict=True):
                text = unescape(formatted[a:a + n])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        if done:
            yield table(done)
    if state is not None:
        yield table([close(state)])


def digests(parts: DataFrame) -> DataFrame:
    """Turns, loss text and length of every conversation, parsed back from its formatted parts.

    Conversations of one part are digested where they lie.  The few parts that a slice
    cut are brought together in order; one task streams a conversation's parts through
    the hash, since a SHA-256 over a conversation is one sequential pass by definition.
    """
    cut = parts.filter("edge").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    whole = map_arrow(parts.filter("NOT edge"), _digest, _DIGEST_SCHEMA)
    return whole.unionByName(map_arrow(cut, _digest, _DIGEST_SCHEMA))


def op1_chat_format(conversations: DataFrame) -> DataFrame:
    """Write the formatted conversations and read their digests back; one row a conversation."""
    return digests(stored(format_conversations(conversations), "chat-formatted"))
