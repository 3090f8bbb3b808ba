"""MinHash near-duplicates (operator 3): a multi-index Hamming join over b-bit signatures.

1. Every whole text becomes its set of k-word shingles (64-bit hashes), and the set a
   signature of ``5 m`` symbols of 16 bits, the low bits of its minwise hashes.  Two sets
   of similarity J agree in a symbol with probability J.
2. Equal sets (size and 128-bit digest) become one representative, the smallest doc_id.
3. Signatures are cut into m chunks of 5 symbols.  Two signatures at distance at most
   ``D = 2 m - 1`` have a chunk with at most one differing symbol (pigeonhole); so each
   chunk is indexed under its 5 keys with one symbol left out, and every pair within D
   meets under some key.  m is the smallest for which a pair of sets just at the
   similarity threshold is farther apart than D with probability under ``MISS``.
4. Under a key no pairs are emitted: members are dealt in blocks, each task compares
   the signatures of two blocks and returns a spanning forest of the pairs within D.
   Components of these forests are clusters that no link leaves.
5. The sets of clustered representatives are computed from their whole texts again, dealt
   in pairs of blocks of a cluster, and pairs within D are confirmed on the full sets,
   nearest first; pairs already joined in the task are skipped.  The confirmed links'
   components are the answer.

Texts move once (only when some text has a neighbour), sets of clustered documents twice.

Edge cases: a text without words (null, empty, white space) has no shingles and links
with nothing; fewer than k words are one shingle; rows with a null doc_id link with
nothing (component null, kept); rows that share a doc_id are one document; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, map_arrow, numbered, pick, sorted_runs, stored
from .graph import components
from .kernels import SPACED, U, doc_windows, mix, splitmix, text_slices, window_hashes, word_counts, words

CHUNK = 5
ERRORS = 1
MISS = 2e-4
BLOCK = 512
SHINGLES_PER_WEIGHT = 4096


def chunks_for(percent: int, miss: float = MISS) -> int:
    """Chunks needed so that sets of similarity ``percent`` / 100 stay within the distance guaranteed."""
    p, m = 1 - percent / 100, 1
    while True:
        k, d = CHUNK * m, (ERRORS + 1) * m - 1
        if sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(d + 1, k + 1)) <= miss:
            return m
        m += 1


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a slice, sorted, and the number in each text."""
    h, s, _ = words(buf, off, SPACED)
    per = word_counts(s, off)
    found, doc = doc_windows(h, per, k)
    first = np.cumsum(per) - per
    for n in range(1, k):
        short = np.flatnonzero(per == n)
        if len(short):
            found = np.concatenate((found, window_hashes(h, n)[first[short]]))
            doc = np.concatenate((doc, short))
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.bincount(doc[new], minlength=len(off) - 1)


def signatures(shingles: np.ndarray, counts: np.ndarray, symbols: int) -> np.ndarray:
    """16-bit minwise symbols of every set (zeros for an empty one)."""
    out = np.zeros((len(counts), symbols), dtype=np.uint16)
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    if len(starts):
        keys = splitmix(2 * symbols, 0x5EED)
        for j in range(symbols):
            least = np.minimum.reduceat((shingles ^ keys[2 * j]) * (keys[2 * j + 1] | U(1)), starts)
            out[full, j] = (mix(least) >> U(48)).astype(np.uint16)
    return out


def _sum_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U), np.cumsum(values, dtype=U)))
    ends = np.cumsum(counts)
    return (total[ends] - total[ends - counts]).view(np.int64)


def _binary_rows(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a], pa.binary())


def sketch(docs: DataFrame, k: int, symbols: int) -> DataFrame:
    """doc_id, n_shingles, 128-bit digest of the set (d1, d2) and signature of every whole text."""

    def look(batches):
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(1)):
                sh, n = shingle_sets(buf, off, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                     pa.array(_sum_by(mix(sh), n)), pa.array(_sum_by(mix(sh ^ U(0xA5A5A5A5A5A5A5A5)), n)),
                     _binary_rows(signatures(sh, n, symbols))],
                    ["doc_id", "n_shingles", "d1", "d2", "sig"])

    return map_arrow(pick(docs, "doc_id", "text"), look, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _matrix(column, dtype=np.uint16) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def chunk_keys(reps: DataFrame, m: int) -> DataFrame:
    """``key, id``: every chunk of every signature under its keys with ``ERRORS`` symbols left out."""
    kept = list(combinations(range(CHUNK), CHUNK - ERRORS))

    def look(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column(1)).astype(U)
            out = []
            for c in range(m):
                for number, places in enumerate(kept):
                    v = np.full(len(sig), U(c * len(kept) + number + 1))
                    for p in places:
                        v = mix(v * U(0x9FB21C651E98DF25) + sig[:, c * CHUNK + p])
                    out.append(v)
            keys = np.stack(out, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), b.column(0).take(pa.array(np.repeat(np.arange(len(sig)), keys.shape[1])))],
                ["key", "id"])

    return map_arrow(reps.select("id", "sig"), look, "key long, id long")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros((len(a), len(b)), dtype=np.uint8 if a.shape[1] < 256 else np.uint16)
    for j in range(a.shape[1]):
        d += a[:, j, None] != b[None, :, j]
    return d


def spanning_forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric adjacency matrix."""
    left = near.any(axis=1)
    edges = []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            reach = near[front] & left
            new = np.flatnonzero(reach.any(axis=0))
            edges.extend(zip(front[reach[:, new].argmax(axis=0)].tolist(), new.tolist(), strict=True))
            left[new] = False
            front = new
    return edges


def candidate_forest(members: DataFrame, distance: int) -> DataFrame:
    """Edges ``a, b``: a spanning forest of the pairs within ``distance`` of every two blocks under a key.

    ``members``: key, _i, _j, _b, id, sig.
    """

    def look(batches):
        for t, bounds in sorted_runs(batches, ["key", "_i", "_j"]):
            ids, sig = t.column("id").to_numpy(), _matrix(t.column("sig"))
            cross = t.column("_i").to_numpy() != t.column("_j").to_numpy()
            block = t.column("_b").to_numpy()
            sizes = np.diff(bounds)
            first = np.repeat(bounds[:-1], sizes)
            close = (sig != sig[first]).sum(axis=1) <= distance
            # whole group near its first member: a star joins it
            star = np.logical_and.reduceat(close, bounds[:-1]) & ~cross[bounds[:-1]]
            rows = np.flatnonzero(np.repeat(star, sizes) & (ids != ids[first]))
            a, b = [ids[first[rows]]], [ids[rows]]
            for g in np.flatnonzero(~star):
                lo, hi = bounds[g], bounds[g + 1]
                near = _distances(sig[lo:hi], sig[lo:hi]) <= distance
                if cross[lo]:
                    near &= block[lo:hi, None] != block[None, lo:hi]
                np.fill_diagonal(near, False)
                for x, y in spanning_forest(near):
                    if ids[lo + x] != ids[lo + y]:
                        a.append(ids[[lo + x]])
                        b.append(ids[[lo + y]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    dealt = members.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")
    return map_arrow(dealt, look, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cluster_sets(docs: DataFrame, clusters: DataFrame, k: int, symbols: int) -> DataFrame:
    """id, cluster, n, set (sorted hashes) and signature of the documents of ``clusters``, from their whole texts."""

    def look(batches):
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(2)):
                sh, n = shingle_sets(buf, off, k)
                ends = np.cumsum(n).tolist()
                raw = sh.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                     pa.array([raw[8 * a:8 * z] for a, z in zip([0, *ends], ends, strict=False)], pa.binary()),
                     _binary_rows(signatures(sh, n, symbols))],
                    ["id", "cluster", "n", "set", "sig"])

    own = clusters.select("id", F.col("component").alias("cluster")).hint("shuffle_hash")
    texts = pick(docs, "doc_id", "text").join(own, F.col("doc_id") == F.col("id")).select("id", "cluster", "text")
    return map_arrow(texts, look, "id long, cluster long, n long, set binary, sig binary").filter("n > 0")


def confirmed_links(sets: DataFrame, percent: int, distance: int) -> DataFrame:
    """Links ``a, b`` confirmed on full sets that join what is joined by any link within a cluster."""
    members = block_pairs(sets, "cluster", "id", BLOCK, 1 + F.col("n") / SHINGLES_PER_WEIGHT)

    def look(batches):
        for t, bounds in sorted_runs(batches, ["cluster", "_i", "_j"]):
            ids, n, block = (t.column(c).to_numpy() for c in ("id", "n", "_b"))
            cross = t.column("_i").to_numpy() != t.column("_j").to_numpy()
            sig, raw = _matrix(t.column("sig")), t.column("set").combine_chunks()
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                size = n[lo:hi]
                d = _distances(sig[lo:hi], sig[lo:hi]).astype(np.int64)
                ok = np.triu(d <= distance, 1)
                ok &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
                if cross[lo]:
                    ok &= block[lo:hi, None] != block[None, lo:hi]
                x, y = np.nonzero(ok)
                order = np.argsort(d[x, y], kind="stable")
                root = list(range(hi - lo))

                def find(v, root=root):
                    while root[v] != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    return v

                opened: dict[int, np.ndarray] = {}
                for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
                    p, q = find(i), find(j)
                    if p == q:
                        continue
                    for v in (i, j):
                        if v not in opened:
                            opened[v] = np.frombuffer(raw[lo + v].as_buffer(), dtype="<u8")
                    one, two = (i, j) if size[i] <= size[j] else (j, i)
                    at = np.searchsorted(opened[two], opened[one])
                    at[at == len(opened[two])] = 0
                    both = int((opened[two][at] == opened[one]).sum())
                    if 100 * both >= percent * (int(size[i]) + int(size[j]) - both):
                        root[max(p, q)] = min(p, q)
                        a.append(int(ids[lo + i]))
                        b.append(int(ids[lo + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.repartition("cluster", "_i", "_j").sortWithinPartitions("cluster", "_i", "_j")
    return map_arrow(dealt, look, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every row."""
    m = chunks_for(percent)
    symbols, distance = CHUNK * m, (ERRORS + 1) * m - 1
    base = stored(sketch(docs, shingle, symbols), "near-sketch")
    linkable = base.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    same = ["n_shingles", "d1", "d2"]
    tagged = stored(linkable.join(linkable.groupBy(*same).agg(F.min("doc_id").alias("rep")), same)
                    .select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")), "near-reps")
    reps = tagged.filter("doc_id = rep").select(F.col("doc_id").alias("id"), "sig").dropDuplicates()
    members = block_pairs(chunk_keys(reps, m), "key", "id", BLOCK).join(reps, "id")
    clusters = components(candidate_forest(members, distance))
    sets = stored(cluster_sets(docs, clusters, shingle, symbols), "near-sets")
    # the sets of one doc_id are one node
    several = tagged.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_most")).filter("a != _most").select("doc_id", "a")
    own = tagged.select("doc_id", F.col("rep").alias("b")).join(several, "doc_id").filter("a != b").select("a", "b")
    classes = components(confirmed_links(sets, percent, distance).unionByName(own))
    linked = (tagged.drop("sig").join(classes, F.col("rep") == F.col("id"), "left")
              .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")))
    alone = (base.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
             .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(docs: DataFrame) -> DataFrame:
    """3-word shingles, links from a similarity of 85 in 100."""
    return near_duplicates(docs, 3, 85)


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates (the smallest doc_id), with its own columns.

    Of rows that repeat that doc_id, the one whose text has the smallest hash stays.
    """
    plain, names = numbered(docs)
    key, text = f"_{names.index('doc_id')}", f"_{names.index('text')}"
    kept = near_duplicates(docs, shingle, percent).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = stored(kept, "near-kept")
    rows = plain.join(kept.hint("shuffle_hash"), F.col(key) == F.col("doc_id"))
    single = rows.filter("n = 1").select(*plain.columns)
    several = rows.filter("n > 1").withColumn("_h", F.xxhash64(text))
    first = several.groupBy("doc_id").agg(F.min("_h").alias("_m"))
    one = (several.join(first, "doc_id").filter("_h = _m").dropDuplicates(["doc_id"]).select(*plain.columns))
    return single.unionByName(one).unionByName(plain.filter(F.col(key).isNull())).toDF(*names)
