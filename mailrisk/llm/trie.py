"""Conversation prefix trie (operator 12): minimal-perfect-hash node tables per shard.

Conversations are rebuilt first (see :func:`rebuilt`): conversation c takes the first h original
turns of conversation c - c % 100 and then its own turns after its first h.  Every distinct
sequence of first d rebuilt turns is a node.

Digests.  A turn is the SHA-256 of its role and text.  A prefix is a pair of polynomials over
its turn digests modulo 2**61 - 1; they add up along a conversation, so a conversation that
lies on many tasks (sorted by range) is numbered and digested by one scan of each task's rows
and one small table of what stands before.  No text is shuffled.

Shards.  A conversation is cut into blocks of ``BLOCK`` depths and the blocks are dealt by hash
into shards of about ``SHARD_ROWS`` rows, whatever the size or skew of the input.  In a shard the
distinct prefix digests get the slots of a minimal perfect hash.  Slots are verified: the digest,
the parent, the turn and the depth of every row must equal what stands in its slot, there and
again when the shards' nodes are joined; a difference is an error, never a merged node.  Counts
are scattered into flat arrays; the totals of subtrees are accumulated through the parent-slot
array from the deepest nodes up.

Merging.  A node's own share of a total (saved tokens, being a leaf) is put into one shard only,
that of the smallest member, whose whole path lies there; so the sum of the shards' totals of a
node is the total of its subtree.  What lies in deeper blocks of a conversation enters at the
last node of the block above.

Edge cases: a null turn sorts first; rows with the same turn go by the SHA-256 of role and text;
null role or text is empty; rows with a null conv_id belong to no conversation; ``%`` truncates
towards zero, so a negative conversation's base lies nearer to zero; a conversation without
rebuilt turns is a member of the root alone; an empty table has no members, so no root and no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import mphf
from .common import crc32_of_id, map_arrow, partitions, pick, sorted_runs, stored
from .kernels import U, mix

BLOCK = 1 << 14
SHARD_ROWS = 1 << 16
GROUP, MOST = 100, 6  # c - c % GROUP is the base; h = crc32 % MOST

P = (1 << 61) - 1
BASES = (0x1A2B3C4D5E6F7081 % P, 0x0F1E2D3C4B5A6978 % P)
_LOW31, _LOW30 = U((1 << 31) - 1), U((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(P)) + (x >> U(61))
    return np.where(x >= U(P), x - U(P), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo P of values below P."""
    a1, a0, b1, b0 = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(U(2) * a1 * b1 + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + a0 * b0)


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduced(a + b)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduced(a + (U(P) - b))


def power(base: int, exponent: np.ndarray) -> np.ndarray:
    """``base ** exponent`` modulo P for non-negative exponents."""
    distinct, at = np.unique(exponent.astype(np.int64), return_inverse=True)
    return np.array([pow(base, int(e), P) for e in distinct], dtype=U)[at] if len(distinct) else np.zeros(0, U)


def _sums(v: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running sums modulo P of ``v`` (below P), each from the row ``start[i]`` on; at most 2**30 rows."""
    out = []
    for part in (v >> U(31), v & _LOW31):
        total = np.concatenate((np.zeros(1, U), np.cumsum(part, dtype=U)))
        out.append(total[1:] - total[start])
    return plus(times(_reduced(out[0]), np.full(len(v), 1 << 31, U)), _reduced(out[1]))


def _turn_digest() -> Column:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


_SCAN = "conv_id long, part int, pos long, t1 long, t2 long, chars long, p1 long, p2 long, last boolean"


def _scan(batches):
    """Number and digest the sorted turns of a task; ``last`` marks a conversation's last row there."""
    part, carry, waiting = TaskContext.get().partitionId(), None, None

    def done(b, following):
        nonlocal carry
        conv = b.column("conv_id").to_numpy()
        n = len(conv)
        raw = np.frombuffer(b"".join(b.column("digest").to_pylist()), dtype="<u8").reshape(n, 4)
        new = np.ones(n, dtype=bool)
        new[1:] = conv[1:] != conv[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        pos = np.arange(n) - start
        same = carry is not None and carry[0] == conv[0]
        run = start == 0
        if same:
            pos[run] += carry[1]
        prefixes = []
        for j, base in enumerate(BASES):
            s = _sums(times(_reduced(raw[:, j]), power(base, pos)), start)
            if same:
                s[run] = plus(s[run], np.full(int(run.sum()), carry[2 + j], U))
            prefixes.append(s)
        carry = (conv[-1], int(pos[-1]) + 1, int(prefixes[0][-1]), int(prefixes[1][-1]))
        last = np.ones(n, dtype=bool)
        last[:-1] = new[1:]
        last[-1] = following is None or following != conv[-1]
        cols = [conv, np.full(n, part, np.int32), pos, raw[:, 0].view(np.int64), raw[:, 1].view(np.int64), b.column("chars").to_numpy(),
                *[p.view(np.int64) for p in prefixes], last]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], [c.split()[0] for c in _SCAN.split(", ")])

    for b in batches:
        if not b.num_rows:
            continue
        if waiting is not None:
            yield done(waiting, b.column("conv_id")[0].as_py())
        waiting = b
    if waiting is not None:
        yield done(waiting, None)


def _before(batches):
    """For the parts of each conversation in order: its turns and digest before that part, and how many it has in all."""
    for t, bounds in sorted_runs(batches, ["conv_id"]):
        n, p = t.column("n").to_numpy(), [t.column(c).to_numpy() for c in ("p1", "p2")]
        ahead, digest, total = np.zeros(len(n), np.int64), np.zeros((2, len(n)), np.int64), np.zeros(len(n), np.int64)
        size = np.diff(bounds)
        total[:] = np.repeat(np.add.reduceat(n, bounds[:-1]), size)
        for a, z in zip(bounds[:-1][size > 1].tolist(), bounds[1:][size > 1].tolist(), strict=True):
            for i in range(a + 1, z):
                ahead[i] = ahead[i - 1] + n[i - 1]
                for j, base in enumerate(BASES):
                    digest[j, i] = (int(digest[j, i - 1]) + int(p[j][i - 1]) * pow(base, int(ahead[i - 1]), P)) % P
        yield pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks(), t.column("part").combine_chunks(),
                                          *[pa.array(c) for c in (ahead, digest[0], digest[1], total)]],
                                         ["conv_id", "part", "ahead", "b1", "b2", "n"])


def _whole(batches):
    """Positions and digests counted from a conversation's first turn, whatever task they lie on."""
    for b in batches:
        ahead = b.column("ahead").fill_null(0).to_numpy()
        cols = {c: b.column(c) for c in ("conv_id", "pos", "t1", "t2", "chars", "p1", "p2")}
        if ahead.any():
            cols["pos"] = pa.array(cols["pos"].to_numpy() + ahead)
            for j, base in enumerate(BASES):
                own, front = (b.column(f"{c}{j + 1}").fill_null(0).to_numpy().view(U) for c in "pb")
                cols[f"p{j + 1}"] = pa.array(plus(front, times(own, power(base, ahead))).view(np.int64))
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Original turns ``(conv_id, pos, t1, t2, chars, p1, p2)`` with the digest of the prefix up to each, and ``(conv_id, n)``."""
    spark = conversations.sparkSession
    rows = (pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _turn_digest().alias("digest"),
                    F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie")))
    order = ["conv_id", "turn", "digest"]
    ordered = rows.repartitionByRange(partitions(spark), *order, "tie").sortWithinPartitions(*order).select("conv_id", "digest", "chars")
    scanned = stored(map_arrow(ordered, _scan, _SCAN), "trie-turns")
    runs = scanned.filter("last").select("conv_id", "part", (F.col("pos") + 1).alias("n"), "p1", "p2")
    runs = stored(map_arrow(runs.repartition("conv_id").sortWithinPartitions("conv_id", "part"), _before,
                            "conv_id long, part int, ahead long, b1 long, b2 long, n long"), "trie-runs")
    # a task's rows continue at most one conversation of the tasks before, so this has at most one row a task
    later = runs.filter("ahead > 0").drop("n")
    whole = map_arrow(scanned.join(F.broadcast(later), ["conv_id", "part"], "left"), _whole,
                      "conv_id long, pos long, t1 long, t2 long, chars long, p1 long, p2 long")
    return whole, runs.filter("ahead = 0").select("conv_id", "n")


_ROW = "conv_id long, d long, k1 long, k2 long, q1 long, q2 long, t1 long, t2 long, chars long, last boolean"


def _own(batches):
    """Own turns after the first h: their depth and digest behind the base's first k turns."""
    inverse = [[pow(pow(base, -1, P), i, P) for i in range(MOST)] for base in BASES]
    for b in batches:
        n = {c: b.column(c).to_numpy() for c in ("conv_id", "pos", "h", "k", "total", "t1", "t2", "chars")}
        d = n["pos"] + 1 - n["h"] + n["k"]
        keys = []
        for j in range(2):
            p, s, a = (b.column(f"{c}{j + 1}").to_numpy().view(U) for c in "psa")
            keys.append(plus(a, times(minus(p, s), np.array(inverse[j], dtype=U)[n["h"] - n["k"]])))
        yield _rows(n["conv_id"], d, keys, [n["t1"], n["t2"]], n["chars"], d == n["total"])


def _base(batches):
    """The base's first turns in a rebuilt conversation: already at their depth."""
    for b in batches:
        n = {c: b.column(c).to_numpy() for c in ("conv_id", "pos", "total", "t1", "t2", "chars", "p1", "p2")}
        yield _rows(n["conv_id"], n["pos"] + 1, [n["p1"].view(U), n["p2"].view(U)], [n["t1"], n["t2"]], n["chars"], n["pos"] + 1 == n["total"])


def _rows(conv, d, keys, turn, chars, last) -> pa.RecordBatch:
    above = [minus(k, times(_reduced(t.view(U)), power(base, d - 1))) for k, t, base in zip(keys, turn, BASES, strict=True)]
    cols = [conv, d, *[k.view(np.int64) for k in keys], *[q.view(np.int64) for q in above], *turn, chars, last]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in _ROW.split(", ")])


def rebuilt(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per rebuilt conversation and depth, the root's (d = 0) included: digests of the prefix (k), its parent (q) and its last turn (t)."""
    whole, convs = turns(conversations)
    first = stored(whole.filter(F.col("pos") < MOST - 1), "trie-first")  # at most five rows a conversation
    convs = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
                         (crc32_of_id("conv_id") % MOST).cast("long").alias("h"))
    n_base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(n_base, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    at_k = first.select(F.col("conv_id").alias("base"), (F.col("pos") + 1).alias("k"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    at_h = first.select("conv_id", (F.col("pos") + 1).alias("h"), F.col("p1").alias("s1"), F.col("p2").alias("s2"))
    info = (convs.join(at_k, ["base", "k"], "left").join(at_h, ["conv_id", "h"], "left")
            .withColumn("total", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
            .fillna(0, ["a1", "a2", "s1", "s2"]))
    info = stored(info.select("conv_id", "base", "n", "h", "k", "total", "a1", "a2", "s1", "s2"), "trie-info")
    base = map_arrow(info.select("conv_id", "base", "k", "total").join(first.withColumnRenamed("conv_id", "base"), "base")
                     .filter("pos < k").drop("base", "k"), _base, _ROW)
    # a long conversation meets its row of figures block by block, so no key holds more than a block
    blocks = info.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {block}"))))
    own = map_arrow(whole.withColumn("block", F.expr(f"pos div {block}")).join(blocks.drop("base", "n"), ["conv_id", "block"])
                    .filter("pos >= h").drop("block"), _own, _ROW)
    zero = [F.lit(0).cast("long").alias(c) for c in ("d", "k1", "k2", "q1", "q2", "t1", "t2", "chars")]
    root = info.select("conv_id", *zero, (F.col("total") == 0).alias("last"))
    return stored(base.unionByName(own).unionByName(root), "trie-rows")


class Slots:
    """A minimal perfect hash over the distinct digests of a shard, verified digest by digest."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        order = np.lexsort((k2, k1))
        a, b = k1[order], k2[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        self.seed = 0
        while len(np.unique(keys := self._mixed(a, b))) < len(keys):
            self.seed += 1
        self.function, slot = mphf.build(keys)
        self.k = np.zeros((2, len(keys)), dtype=np.int64)
        self.k[0, slot], self.k[1, slot] = a, b

    def _mixed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(mix(a.view(U) + U(self.seed)) ^ (b.view(U) * U(0x9E3779B97F4A7C15)))

    def __len__(self) -> int:
        return self.k.shape[1]

    def of(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slot of each digest; -1 where the shard has no such node."""
        slot = mphf.lookup(self.function, self._mixed(np.ascontiguousarray(k1), np.ascontiguousarray(k2)))
        slot[slot >= len(self)] = -1
        return np.where((slot >= 0) & (self.k[0, slot] == k1) & (self.k[1, slot] == k2), slot, -1)


_NODE = ["k1", "k2", "q1", "q2", "t1", "t2", "chars", "d"]
_LOCAL = "shard long, " + ", ".join(f"{c} long" for c in _NODE) + ", n long, conv_id long, goes_on boolean"


def _enumerate(batches):
    """One row per shard and node: how many rows of the shard are its members, the smallest, and whether one goes on."""
    for t, bounds in sorted_runs(batches, ["shard"]):
        col = {c: t.column(c).to_numpy() for c in (*_NODE, "shard", "conv_id", "last", "ghost")}
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            g = {c: np.ascontiguousarray(v[a:z]) for c, v in col.items()}
            slots = Slots(g["k1"], g["k2"])
            slot, m = slots.of(g["k1"], g["k2"]), len(slots)
            out = {}
            for c in _NODE:
                out[c] = np.zeros(m, np.int64)
                out[c][slot] = g[c]
                if (out[c][slot] != g[c]).any():
                    raise ValueError("two different prefixes have the same digest")
            real = ~g["ghost"]
            out["n"] = np.bincount(slot[real], minlength=m)
            least = np.full(m, np.iinfo(np.int64).max)
            np.minimum.at(least, slot[real], g["conv_id"][real])
            on = np.zeros(m, dtype=bool)
            on[slot[real & ~g["last"]]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, g["shard"][0])), *[pa.array(out[c]) for c in (*_NODE, "n")], pa.array(least, mask=out["n"] == 0), pa.array(on)],
                [c.split()[0] for c in _LOCAL.split(", ")])


_MERGED = "k1 long, k2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _accumulate(block, batches):
    """Subtree totals of each shard's own shares, through the parent slots in order of falling depth."""
    for t, bounds in sorted_runs(batches, ["shard"]):
        cols = ("k1", "k2", "q1", "q2", "d", "own", "n_convs", "conv_id", "leaf", "weight", "carry")
        col = {c: t.column(c).to_numpy() for c in cols}
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            g = {c: v[a:z] for c, v in col.items()}
            carry = {c: v[g["carry"]] for c, v in g.items()}
            g = {c: np.ascontiguousarray(v[~g["carry"]]) for c, v in g.items()}
            slots = Slots(g["k1"], g["k2"])
            m, slot = len(slots), slots.of(g["k1"], g["k2"])

            def laid(values, kind=np.int64, m=m, slot=slot):
                out = np.zeros(m, kind)
                out[slot] = values
                return out

            depth, own, conv, n = laid(g["d"]), laid(g["own"], bool), laid(g["conv_id"]), laid(g["n_convs"])
            parent = slots.of(laid(g["q1"]), laid(g["q2"]))
            parent[depth == 0] = -1
            totals = [laid(g["leaf"]), laid(g["weight"])]
            at = slots.of(carry["k1"], carry["k2"])
            for total, c in zip(totals, ("leaf", "weight"), strict=True):
                np.add.at(total, at, carry[c])
            order = np.argsort(-depth, kind="stable")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(depth[order])) + 1, [m]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here = order[x:y]
                if depth[here[0]] % block:  # a block's top hands nothing up: the block above gets its total by a carry
                    for total in totals:
                        np.add.at(total, parent[here], total[here])
            inner = own & (parent >= 0)
            children = np.bincount(parent[inner], minlength=m)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x) for x in (slots.k[0], slots.k[1], conv, depth)], pa.array(conv[parent], mask=~inner),
                 *[pa.array(x) for x in (n, children, *totals)]], [c.split()[0] for c in _MERGED.split(", ")])


_PIECES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int64()), ("text", pa.binary()), ("sha", pa.string())])


def _ends(batches):
    """Digest of each node's ending conversations, or pieces of the text to be digested (sha null).

    A task's first and last node may have more conversations on its neighbours, and a long
    one is handed on batch by batch; all others are digested here.
    """
    state, held, in_pieces, part = None, b"", True, TaskContext.get().partitionId() << 33

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], _PIECES.names)

    for b in batches:
        if not b.num_rows:
            continue
        k1, k2, conv = (b.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
        new = np.ones(len(k1), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        at = np.flatnonzero(new).tolist()
        done = []
        for a, z in zip(at, [*at[1:], len(k1)], strict=True):
            key, text = (int(k1[a]), int(k2[a])), ",".join(map(str, conv[a:z].tolist())).encode()
            if state is not None:
                in_pieces = in_pieces or key == state
                done.append((*state, part, held, None) if in_pieces else (*state, part, None, hashlib.sha256(held).hexdigest()))
                in_pieces = key == state
            state, held, part = key, text, part + 1
        if done:
            yield out(done)
    if state is not None:
        yield out([(*state, part, held, None)])


def _joined(batches):
    """Digest of the pieces of each node in order, one streaming pass."""
    state, sha, names = None, None, ["k1", "k2", "sha"]

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done]), pa.array([k[1] for k, _ in done]), pa.array([s for _, s in done])], names)

    for b in batches:
        done = []
        for k1, k2, text in zip(*[b.column(c).to_pylist() for c in ("k1", "k2", "text")], strict=True):
            if state != (k1, k2):
                if state is not None:
                    done.append((state, sha.hexdigest()))
                state, sha = (k1, k2), hashlib.sha256(text)
            else:
                sha.update(b"," + text)
        if done:
            yield out(done)
    if state is not None:
        yield out([(state, sha.hexdigest())])


def end_digests(rows: DataFrame) -> DataFrame:
    """``(k1, k2, sha)``: SHA-256 of the ids of the conversations that end at each node.

    Ids are sorted by range, so a node where a third of all conversations end lies on many
    tasks, which write its text; only the hash over that text, sequential by definition, is one pass.
    """
    ended = rows.filter("last").select("k1", "k2", "conv_id")
    ordered = ended.repartitionByRange(partitions(rows.sparkSession), "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = stored(map_arrow(ordered, _ends, "k1 long, k2 long, part long, text binary, sha string"), "trie-ends")
    cut = pieces.filter("sha IS NULL").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part")
    return pieces.filter("sha IS NOT NULL").select("k1", "k2", "sha").unionByName(
        map_arrow(cut.select("k1", "k2", "text"), _joined, "k1 long, k2 long, sha string"))


def prefix_trie(conversations: DataFrame, block_depths: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations with their figures (see the contract's columns)."""
    rows = rebuilt(conversations, block_depths)
    shards = max(1, -(-rows.count() // shard_rows))

    def shard(block: Column) -> Column:
        return F.pmod(F.xxhash64("conv_id", block), F.lit(shards)).alias("shard")

    block = F.expr(f"d div {block_depths}")
    edge = rows.filter(~F.col("last") & (F.col("d") % block_depths == block_depths - 1))
    dealt = (rows.withColumn("ghost", F.lit(False)).select("*", shard(block))
             .unionByName(edge.withColumn("ghost", F.lit(True)).select("*", shard(block + 1))))
    local = stored(map_arrow(dealt.repartition("shard").sortWithinPartitions("shard"), _enumerate, _LOCAL), "trie-nodes")

    same = ["q1", "q2", "t1", "t2", "chars", "d"]
    nodes = local.groupBy("k1", "k2").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("g_conv"), F.max("goes_on").alias("goes_on"),
                                          *[f(c).alias(f"{c}_{f.__name__}") for c in same for f in (F.min, F.max)])
    differ = F.greatest(*[(F.col(f"{c}_min") != F.col(f"{c}_max")).cast("int") for c in same]) > 0
    checked = F.when(differ, F.raise_error(F.lit("two different prefixes have the same digest")).cast("long")).otherwise(F.col("n_convs"))
    nodes = nodes.select("k1", "k2", checked.alias("n_convs"), "g_conv", "goes_on")
    own = F.coalesce(F.col("conv_id") == F.col("g_conv"), F.lit(False))
    placed = stored(local.drop("goes_on").join(nodes, ["k1", "k2"]).select(
        "shard", "k1", "k2", "q1", "q2", "d", own.alias("own"), "n_convs", F.col("g_conv").alias("conv_id"),
        F.when(own & ~F.col("goes_on"), 1).otherwise(0).cast("long").alias("leaf"),
        F.when(own, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).cast("long").alias("weight")), "trie-placed")

    # what a conversation owns in its deeper blocks enters at the last node of the block above
    owned = (placed.filter(F.col("own") & (F.col("d") >= block_depths)).groupBy("conv_id", block.alias("block"))
             .agg(F.sum("leaf").alias("leaf"), F.sum("weight").alias("weight")))
    edges = edge.select("conv_id", "k1", "k2", (block + 1).alias("block"), shard(block))
    below = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    carries = (edges.join(owned, ["conv_id", "block"], "left")
               .withColumn("leaf", F.sum(F.coalesce("leaf", F.lit(0))).over(below)).withColumn("weight", F.sum(F.coalesce("weight", F.lit(0))).over(below)))
    no = [F.lit(0).cast("long").alias(c) for c in ("q1", "q2", "d", "n_convs")]
    carried = carries.select("shard", "k1", "k2", *no[:3], F.lit(False).alias("own"), no[3], "conv_id", "leaf", "weight")
    laid = placed.withColumn("carry", F.lit(False)).unionByName(carried.withColumn("carry", F.lit(True)))
    totals = map_arrow(laid.repartition("shard").sortWithinPartitions("shard"), functools.partial(_accumulate, block_depths), _MERGED)
    trie = totals.groupBy("k1", "k2").agg(*[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")],
                                          *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    nothing = hashlib.sha256(b"").hexdigest()
    return (trie.join(end_digests(rows), ["k1", "k2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("sha", F.lit(nothing)).alias("ends_sha256")))


def op12_prefix_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations)


#: crc32 of a decimal id, bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

ORACLE = f"""
WITH original AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT c FROM original)
), rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM (
    SELECT v.c, false AS own, o.pos, o.role, o.text FROM convs v JOIN original o ON o.c = v.base AND o.pos <= v.h
    UNION ALL SELECT v.c, true, o.pos, o.role, o.text FROM convs v JOIN original o ON o.c = v.c AND o.pos > v.h)
), paths AS (
  SELECT c, d, length(text) AS chars,
         list(sha256(length(role)::VARCHAR || ':' || role || text)) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path
  FROM rebuilt
  UNION ALL SELECT c, 0, 0, []::VARCHAR[] FROM convs
), members AS (
  SELECT c, d, chars, path, d = max(d) OVER (PARTITION BY c) AS ends FROM paths
), nodes AS (
  SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path
), children AS (
  SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), known AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k USING (path)
), subtrees AS (
  SELECT path[:u.a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM known, unnest(range(0, depth + 1)) AS u(a) GROUP BY 1
)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN subtrees s USING (path) LEFT JOIN known p ON k.depth > 0 AND p.path = k.path[:k.depth - 1]
"""
