"""Embedding near-duplicates (operator 4): spherical-cap filters from random product codes.

Vectors are normalised and turned by a fixed random rotation.  The space is cut into
up to ``PARTS`` blocks with random unit codewords each; every combination of one
codeword a block is a filter direction (words to the power of the blocks, never listed).  A vector
is decoded to the list of ALL filters whose inner product with it is at least ``alpha``:
sums over two halves of the blocks are pruned by the best sum of the other half.  Alpha
is set by the code alone, so that a random vector passes ``FILTERS`` filters on average;
a vector that lies badly to the codewords lowers it for itself until ``LEAST`` pass.
The number of codewords follows the number of vectors, so that a random vector meets about
``OCCUPANCY`` others under a filter however many there are.

Equal vectors are one representative with a weight.  The join on filters hands on numbers only;
vectors are sent once per question that is left:

1. Under each filter the smallest id is the leader.  Distinct (member, leader) pairs, found under
   however many filters, are verified once by their cosine in double precision: linear work, and
   the links found join a group of near-copies into one cluster.
2. Filters that still hold vectors of two clusters are dealt in pairs of blocks; a task compares
   what lies in different clusters and returns a spanning forest of the links found.
3. A cluster's links are then counted exactly, each pair once: its members are dealt in pairs of
   blocks, and a task computes all cosines of its two blocks.  No pairs are emitted anywhere.

The search is randomised: a link between clusters is found if both vectors pass a common filter;
inside a cluster every link is found.  The tests measure its recall against brute force.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, as do rows with a null vec_id (component null, kept); vectors of
different lengths are never compared; rows that repeat a vec_id and its vector are one
vector; of a vec_id with several vectors the one whose bytes are smallest counts, the rows of
the others link with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, map_arrow, pick, sorted_runs, stored
from .graph import components
from .near_dedup import spanning_forest

PARTS = 4
FILTERS = 40
LEAST = 48
OCCUPANCY = 0.15
THRESHOLD = 0.95
BLOCK = 1024
CHUNK = 4096  # members verified against their leader in one task's run


def words_for(vectors: int) -> int:
    """Codewords a block, so that all filters together are ``LEAST / OCCUPANCY`` times the vectors."""
    return max(32, 8 * -(-int((vectors * LEAST / OCCUPANCY) ** (1 / PARTS)) // 8))


class Code:
    """Random product code of one dimension; equal in every process."""

    def __init__(self, dim: int, words: int, filters: float = FILTERS):
        rng = np.random.default_rng([2718, dim, words])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.words, self.dim = words, dim
        self.parts = np.array_split(np.arange(dim), min(PARTS, max(1, dim // 2)))  # two dimensions a block at least
        self.books = []
        for p in self.parts:
            c = rng.standard_normal((words, len(p)))
            self.books.append(c / np.linalg.norm(c, axis=1, keepdims=True) / len(self.parts)**0.5)
        trial = rng.standard_normal((48, dim))
        halves = [self._halves(v) for v in trial / np.linalg.norm(trial, axis=1, keepdims=True)]
        halves = [(np.sort(a), np.sort(b)) for a, b in halves]
        low, high = 0.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            mean = np.mean([(len(b) - np.searchsorted(b, mid - a)).sum() for a, b in halves])
            low, high = (mid, high) if mean > filters else (low, mid)
        self.alpha = high

    def _halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all combinations of the first and of the other half of the blocks."""
        s = [c @ v[p] for p, c in zip(self.parts, self.books, strict=True)]
        cut = (len(s) + 1) // 2
        return tuple(functools.reduce(lambda x, y: (x[:, None] + y).ravel(), part, np.zeros(1)) for part in (s[:cut], s[cut:]))

    def decode(self, v: np.ndarray) -> np.ndarray:
        """Sorted numbers of all filters that the unit vector ``v`` passes (the dimension in the upper bits)."""
        a, b = self._halves(self.turn @ v)
        # the LEAST largest sums use at most the LEAST largest terms of either half
        top = [np.partition(x, len(x) - min(LEAST, len(x)))[-LEAST:] for x in (a, b)]
        sums = (top[0][:, None] + top[1]).ravel()
        alpha = min(self.alpha, np.partition(sums, len(sums) - LEAST)[-LEAST]) if len(sums) > LEAST else -1.0
        i = np.flatnonzero(a >= alpha - b.max())
        j = np.flatnonzero(b >= alpha - a.max())
        x, y = np.nonzero(a[i][:, None] + b[j] >= alpha)
        return np.sort(i[x] * len(b) + j[y]) + (self.dim << 32)


@functools.cache
def code(dim: int, words: int) -> Code:
    return Code(dim, words)


def unit(raw: bytes, dtype: str) -> np.ndarray | None:
    """The vector at length one in double precision; None if it cannot have a cosine."""
    v = np.frombuffer(raw, dtype).astype(np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.linalg.norm(v)


def raw_vectors(embeddings: DataFrame) -> tuple[DataFrame, str]:
    """vec_id and the components' bytes (null where there is no cosine), and the component type."""
    dtype = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"

    def look(batches):
        for b in batches:
            lists = b.column(1)
            flat, off = lists.flatten(), np.cumsum([0, *(0 if n is None else n for n in lists.value_lengths().to_pylist())])
            gaps = np.cumsum(np.concatenate(([0], flat.is_null().to_numpy(zero_copy_only=False))))
            v = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(dtype)
            out = []
            for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                raw = v[a:z].tobytes() if gaps[a] == gaps[z] else b""
                out.append(raw if unit(raw, dtype) is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "v"])

    kind = "array<float>" if dtype == "<f4" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind))
    return map_arrow(rows, look, "vec_id long, v binary"), dtype


def units(raw: list[bytes], dtype: str) -> np.ndarray:
    """Unit vectors of one length as the rows of a matrix."""
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def entries(reps: DataFrame, dtype: str, words: int) -> DataFrame:
    """``filter, id``: every filter that a vector passes."""

    def look(batches):
        for b in batches:
            lists = []
            for raw in b.column(1).to_pylist():
                v = unit(raw, dtype)
                lists.append(code(len(v), words).decode(v))
            if lists:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists)), b.column(0).take(pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists])))],
                    ["filter", "id"])

    return map_arrow(reps.select("id", "v"), look, "filter long, id long")


def leader_links(found: DataFrame, reps: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """Links ``a, b`` between vectors and the smallest id under a filter of theirs; each pair is verified once."""
    first = found.groupBy("filter").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("filter", "lead")
    pairs = found.join(first, "filter").filter("id != lead").select("id", "lead").distinct()
    pairs = stored(pairs, "cap-pairs")
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "lead").select("lead", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), "id")
    leads = sizes.select("lead", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("lead").alias("id"))
    rows = dealt.unionByName(leads).join(reps.select("id", "v"), "id")

    def look(batches):
        for t, bounds in sorted_runs(batches, ["lead", "chunk"]):
            ids, lead = t.column("id").to_numpy(), t.column("lead").to_numpy()
            raw = t.column("v").to_pylist()
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                x = units(raw[lo:hi], dtype)
                at = np.flatnonzero(ids[lo:hi] == lead[lo])[0]
                near = np.flatnonzero((x @ x[at] >= threshold) & (ids[lo:hi] != lead[lo]))
                a.append(ids[lo:hi][near])
                b.append(lead[lo:hi][near])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return map_arrow(rows.repartition("lead", "chunk").sortWithinPartitions("lead", "chunk"), look, "a long, b long")


def cluster_links(found: DataFrame, clusters: DataFrame, reps: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """Links ``a, b`` (a spanning forest of them) between vectors of different clusters that pass a common filter."""
    own = found.join(clusters, "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component")
    mixed = own.groupBy("filter").agg(F.min("cluster").alias("_p"), F.max("cluster").alias("_q")).filter("_p != _q").select("filter")
    members = block_pairs(own.join(mixed, "filter"), "filter", "id", BLOCK).join(reps.select("id", "v"), "id")

    def look(batches):
        for t, bounds in sorted_runs(batches, ["filter", "_i", "_j"]):
            ids, cluster, block = (t.column(c).to_numpy() for c in ("id", "cluster", "_b"))
            cross, raw = t.column("_i").to_numpy() != t.column("_j").to_numpy(), t.column("v").to_pylist()
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                c = cluster[lo:hi]
                if (c == c[0]).all():
                    continue
                x = units(raw[lo:hi], dtype)
                near = (x @ x.T >= threshold) & (c[:, None] != c[None, :])
                if cross[lo]:
                    near &= block[lo:hi, None] != block[None, lo:hi]
                if near.any():
                    for p, q in spanning_forest(near):
                        a.append(int(ids[lo + p]))
                        b.append(int(ids[lo + q]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.repartition("filter", "_i", "_j").sortWithinPartitions("filter", "_i", "_j")
    return map_arrow(dealt, look, "a long, b long")


def link_counts(members: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """``id, n``: vectors linked to each, over all pairs of a cluster (``cluster, id, v, w``); rows of one id add up."""

    def look(batches):
        for t, bounds in sorted_runs(batches, ["cluster", "_i", "_j"]):
            ids, w, block = (t.column(c).to_numpy() for c in ("id", "w", "_b"))
            cross, raw = t.column("_i").to_numpy() != t.column("_j").to_numpy(), t.column("v").to_pylist()
            some, n = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                x = units(raw[lo:hi], dtype)
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if cross[lo]:
                    near &= block[lo:hi, None] != block[None, lo:hi]
                some.append(ids[lo:hi])
                n.append(near @ w[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some)), pa.array(np.concatenate(n).astype(np.int64))], ["id", "n"])

    dealt = block_pairs(members, "cluster", "id", BLOCK).repartition("cluster", "_i", "_j").sortWithinPartitions("cluster", "_i", "_j")
    return map_arrow(dealt, look, "id long, n long")


def op4_cap_filters(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept of every row."""
    raw, dtype = raw_vectors(pick(embeddings, "vec_id", "embedding"))
    base = stored(raw, "cap-vectors")
    one = base.filter("v IS NOT NULL AND vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    reps = one.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"))
    reps = stored(reps, "cap-reps")
    found = stored(entries(reps, dtype, words_for(reps.count())), "cap-entries")
    near = stored(leader_links(found, reps, dtype, threshold), "cap-links")
    clusters = stored(components(near), "cap-clusters")
    far = stored(cluster_links(found, clusters, reps, dtype, threshold), "cap-far-links")
    classes = stored(components(near.unionByName(far)), "cap-classes") if not far.isEmpty() else clusters
    members = classes.select("id", F.col("component").alias("cluster")).join(reps, "id")
    counts = link_counts(members, dtype, threshold).groupBy("id").agg(F.sum("n").alias("n"))
    per_rep = (reps.join(counts, "id", "left").join(classes, "id", "left")
               .select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    linked = one.join(per_rep, "v").withColumnRenamed("v", "_v")
    here = F.coalesce(F.col("v") == F.col("_v"), F.lit(False))
    return (base.join(linked, "vec_id", "left")
            .select("vec_id", F.when(here, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
                    F.when(here, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
