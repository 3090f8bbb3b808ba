"""Best-fit packing (operator 8): bin completion branch-and-bound over the length histogram.

Items of equal length are interchangeable, so the whole corpus packs as a histogram of
at most ``capacity`` counts: that is all the driver ever sees, whatever the number of
documents.  The solver returns patterns (lengths that share a sequence) with how often
each is used; every item then finds its place from its length and its rank among the
items of that length, by one lookup in a table of at most a few thousand runs.

Edge cases: a null text is an empty text (one end id); longer documents are cut into
``capacity`` pieces and a last shorter one; repeated rows and null doc_ids are packed
like any other row; no documents give no rows.
"""

from __future__ import annotations

import bisect
import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, partitions, pick, stored
from .tokens import encoder

CAPACITY = 2048
NODE_LIMIT = 20_000  # branchings after the first dive; the incumbent is kept beyond
BREADTH = 4  # largest items tried at each step of a filling
PROOF_STEPS = 300_000  # lengths looked at by the search for a proof: a few seconds, and tens of megabytes at most

Pattern = tuple[tuple[int, ...], int]


class Packing(NamedTuple):
    patterns: list[Pattern]
    bins: int
    bound: int  # no packing has fewer bins
    proven: bool  # ``bins`` is the fewest there can be


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """The first incumbent: longest first, each into the fullest bin that holds it.

    Equal items go into equal bins together, so the work follows the number of
    distinct (length, free space) cases and not the number of items.
    """
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            free = min((f for f in open_bins if f >= length), default=None)
            if free is None:
                fits = capacity // length
                whole, part = divmod(left, fits)
                for n, m in ((fits, whole), (part, 1)):
                    if n and m:
                        group = open_bins.setdefault(capacity - n * length, {})
                        group[(length,) * n] = group.get((length,) * n, 0) + m
                break
            group = open_bins[free]
            items, m = group.popitem()
            use = min(m, left)
            if m > use:
                group[items] = m - use
            if not group:
                del open_bins[free]
            to = open_bins.setdefault(free - length, {})
            key = (*items, length)
            to[key] = to.get(key, 0) + use
            left -= use
    return [(items, m) for group in open_bins.values() for items, m in group.items()]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: total length, and for each k what longer items force."""
    lengths = np.arange(len(counts))
    total = int((lengths * counts).sum())
    best = -(-total // capacity)
    for k in np.flatnonzero(counts[:capacity // 2 + 1]):
        big = int(counts[capacity - k + 1:].sum())
        half = slice(capacity // 2 + 1, capacity - k + 1)
        n_half = int(counts[half].sum())
        room = n_half * capacity - int((lengths[half] * counts[half]).sum())
        small = int((lengths[k:capacity // 2 + 1] * counts[k:capacity // 2 + 1]).sum())
        best = max(best, big + n_half + max(0, -(-(small - room) // capacity)))
    return best


def _pairs(counts: np.ndarray, target: int) -> np.ndarray:
    """The larger member of every pair of available lengths with sum ``target``."""
    if target < 2:
        return np.zeros(0, dtype=np.int64)
    a = np.arange((target + 1) // 2, target)
    b = target - a
    ok = (counts[a] > 0) & (counts[b] > 0) & ((a != b) | (counts[a] > 1))
    return a[ok][::-1]


def _dominated(filling: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether the items of ``filling`` fit one by one under the items of ``by``."""
    room = list(by)
    for x in filling:
        i = max(range(len(room)), key=lambda j: (room[j] >= x, -room[j]))
        if room[i] < x:
            return False
        room[i] -= x
    return True


def completions(counts: np.ndarray, room: int, waste_limit: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` that waste at most ``waste_limit``, least waste first.

    A single item that fills the room exactly dominates every other filling, so it
    stands alone.  Otherwise fillings end in the pair that leaves least waste, after
    none to ``depth`` items chosen among the largest; for rooms of many small items
    the largest are taken until a pair can close the rest.
    """
    found: list[tuple[int, tuple[int, ...]]] = []

    def close(c: np.ndarray, r: int, taken: tuple[int, ...], depth: int) -> None:
        if r == 0:
            found.append((0, taken))
            return
        if r < len(c) and c[r] > 0:
            found.append((0, (*taken, r)))
            return
        fit = np.flatnonzero(c[:min(r, len(c) - 1) + 1])
        if not len(fit):
            found.append((r, taken))
            return
        pairs = _pairs(c, r) if r < len(c) else np.zeros(0, dtype=np.int64)
        if len(pairs):
            found.extend((0, (*taken, int(a), r - int(a))) for a in pairs[:BREADTH])
            return
        top = int(fit[-1])
        if 3 * top < r:  # far from the end: take as many of the largest as leave room for a close finish
            n = max(1, min(int(c[top]), (r - 2 * top) // top))
            c = c.copy()
            c[top] -= n
            close(c, r - n * top, (*taken, *(top,) * n), depth)
            return
        if depth:
            for a in fit[::-1][:BREADTH]:
                d = c.copy()
                d[a] -= 1
                close(d, r - int(a), (*taken, int(a)), depth - 1)
                if found and found[-1][0] == 0:
                    break
        else:
            found.append((r - top, (*taken, top)))

    close(counts, room, (), depth)
    out: list[tuple[int, ...]] = []
    for waste, filling in sorted(set(found), key=lambda x: (x[0], len(x[1]), [-y for y in x[1]])):
        if waste <= waste_limit and (not out or not (len(filling) < 8 and any(len(o) < 8 and _dominated(filling, o) for o in out))):
            out.append(filling)
    return out[:BREADTH]


def fillings(counts: list[int], room: int, spare: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Every filling of ``room`` that no further item fits beside and that wastes at most ``spare``, larger
    items first.  All undominated fillings are among them.  ``counts[length]`` items are there, the same whenever
    the next filling is asked for; ``steps[0]`` counts the lengths looked at."""
    if room < len(counts) and counts[room]:  # takes the place of whatever else would fill it
        yield (room,)
        return
    there = [x for x in range(min(room, len(counts) - 1), 0, -1) if counts[x]]
    below = [0] * (len(there) + 1)  # all that this and later lengths could add
    for i in range(len(there) - 1, -1, -1):
        below[i] = below[i + 1] + there[i] * counts[there[i]]
    steps[0] += len(there)
    # next length, room left, taken, smallest left out, how many of that length (None: not chosen yet)
    stack: list[tuple[int, int, tuple[int, ...], int, int | None]] = [(0, room, (), room + 1, None)]
    while stack:
        i, left, taken, out, n = stack.pop()
        steps[0] += 1
        if n is None:
            i = bisect.bisect_left(there, -left, i, key=lambda x: -x)  # longer ones fit no more
            if i == len(there):
                if left <= spare and out > left:
                    yield taken
                continue
            if left - below[i] > spare:
                continue
            n = min(counts[there[i]], left // there[i])
        x = there[i]
        if n:
            stack.append((i, left, taken, out, n - 1))
        stack.append((i + 1, left - n * x, taken + (x,) * n, out if n == counts[x] else min(out, x), None))


def prove(counts: np.ndarray, capacity: int, best: list[Pattern], bound: int, steps: int = PROOF_STEPS) -> tuple[list[Pattern], bool]:
    """Bin completion without a beam: around the largest item left every undominated filling is tried, bin by
    bin, within the waste that a better packing may have.  The fewest bins and True, or the best found after ``steps`` and False."""
    best_bins = sum(m for _, m in best)
    total = int((np.arange(len(counts)) * counts).sum())
    used = [0]
    c = [int(x) for x in counts]
    chosen: list[tuple[int, ...]] = []
    seen: dict[tuple[int, ...], int] = {}

    def options(waste: int, largest: int) -> Iterator[tuple[int, ...]]:
        """Completed bins for the items left in ``c``, none above ``largest``; the generator takes them out and puts them back."""
        used[0] += 8
        while not c[largest]:
            largest -= 1
            used[0] += 1
        c[largest] -= 1
        for filling in fillings(c, capacity - largest, (best_bins - 1) * capacity - total - waste, used):
            for x in filling:
                c[x] -= 1
            yield (largest, *filling)
            for x in filling:
                c[x] += 1
        c[largest] += 1

    if not total:
        return best, True
    levels, wastes, items_left = [options(0, len(c) - 1)], [0], [sum(c)]
    while levels and best_bins > bound:
        if used[0] > steps:
            return best, False
        items = next(levels[-1], None)
        del chosen[len(levels) - 1:]
        if items is None:
            levels.pop()
            wastes.pop()
            items_left.pop()
            continue
        chosen.append(items)
        waste = wastes[-1] + capacity - sum(items)
        if waste > (best_bins - 1) * capacity - total:  # the incumbent became better meanwhile
            continue
        left = tuple(x for x in range(1, len(c)) for _ in range(c[x])) if items_left[-1] - len(items) < 64 else None
        if left == ():
            best, best_bins = [(i, 1) for i in chosen], len(chosen)
            continue
        if left is not None:
            used[0] += len(left)
            if seen.get(left, best_bins) <= len(chosen):
                continue
            seen[left] = len(chosen)
        levels.append(options(waste, items[0]))
        wastes.append(waste)
        items_left.append(items_left[-1] - len(items))
    return best, True


def solve(counts: np.ndarray, capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> list[Pattern]:
    """Patterns that pack ``counts[length]`` items of each length into few bins (see :func:`pack`)."""
    return pack(counts, capacity, node_limit).patterns


def pack(counts: np.ndarray, capacity: int = CAPACITY, node_limit: int = NODE_LIMIT, steps: int = PROOF_STEPS) -> Packing:
    """The packing that the two searches find and whether it is proven to have the fewest bins."""
    counts = np.asarray(counts, dtype=np.int64)
    best, bound = dive(counts, capacity, node_limit), lower_bound(counts, capacity)
    proven = sum(m for _, m in best) == bound
    if not proven:
        best, proven = prove(counts, capacity, best, bound, steps)
    return Packing(best, sum(m for _, m in best), bound, proven)


def dive(counts: np.ndarray, capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> list[Pattern]:
    """The incumbent for :func:`prove`: few fillings a bin, each used as often as it can be.

    Depth-first: complete a bin around the largest length left, use that bin as often
    as the counts allow, go on.  A branch ends when its waste leaves no room to beat
    the incumbent; the search ends at the lower bound or the node limit.
    """
    counts = np.asarray(counts, dtype=np.int64).copy()
    best = best_fit_decreasing(counts, capacity)
    best_bins = sum(m for _, m in best)
    bound = lower_bound(counts, capacity)
    total = int((np.arange(len(counts)) * counts).sum())
    stack: list[tuple[np.ndarray, int, int, tuple | None]] = [(counts, 0, 0, None)]
    nodes, dived = 0, False
    while stack and best_bins > bound and nodes < node_limit + (0 if dived else 10 * capacity):
        c, bins, waste, path = stack.pop()
        nodes += 1
        if waste > (best_bins - 1) * capacity - total:  # no better than the incumbent any more
            continue
        left = np.flatnonzero(c)
        if not len(left):
            if bins < best_bins:
                best_bins, best = bins, []
                while path is not None:
                    best.append(path[0])
                    path = path[1]
            dived, nodes = True, 0 if not dived else nodes
            continue
        largest = int(left[-1])
        rest = c.copy()
        rest[largest] -= 1
        room = capacity - largest
        spare = (best_bins - 1) * capacity - total - waste
        options = completions(rest, room, spare) or completions(rest, room, room)[:1]
        for filling in reversed(options):
            items = (largest, *filling)
            lengths, uses = np.unique(items, return_counts=True)
            times = int((c[lengths] // uses).min())
            lost = capacity - sum(items)
            d = c.copy()
            d[lengths] -= times * uses
            stack.append((d, bins + times, waste + times * lost, ((items, times), path)))
    return best


def runs(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the ranks of each length go: ``count`` ranks from ``rank`` on lie in the sequences from ``sequence`` on."""
    nxt: dict[int, int] = {}
    rows, base = [], 0
    for items, times in patterns:
        offset = 0
        for length in items:
            rank = nxt.get(length, 0)
            rows.append((length, rank, base, offset))
            nxt[length] = rank + times
            offset += length
        base += times
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids (32-bit little endian)."""
    schema = "doc_id long, piece int, start long, length long, ids binary"

    def cut(batches):
        enc = encoder(tokenizer)
        step = 4 * capacity
        for b in batches:
            key = b.column(0)
            for first, encoded in enc.groups(b.column(1)):
                row, piece, size, ids = [], [], [], []
                for i, raw in enumerate(encoded):
                    raw += b"\0\0\0\0"
                    for p in range(0, len(raw), step):
                        part = raw[p:p + step]
                        row.append(first + i)
                        piece.append(p // step)
                        size.append(len(part) // 4)
                        ids.append(part)
                at = np.array(piece, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [key.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(at * capacity),
                     pa.array(size, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

    return map_arrow(pick(docs, "doc_id", "text"), cut, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``."""
    spark = pieces.sparkSession
    ordered = stored(
        pieces.repartitionByRange(partitions(spark), "length", "doc_id", "piece")
        .sortWithinPartitions("length", "doc_id", "piece")
        .withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()), "pack-ordered")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in ordered.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    packing = pack(counts, capacity)
    logging.getLogger(__name__).info("%d sequences, at least %d needed, proven fewest: %s", packing.bins, packing.bound, packing.proven)
    table = runs(packing.patterns)
    below = np.concatenate(([0], np.cumsum(counts)[:-1]))  # items of smaller lengths
    sizes = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first")).orderBy("_pid").collect()
    # one row for each shuffle partition: a setting, not the data, bounds it
    first = {r["_pid"]: (r["_first"], b) for r, b in zip(sizes, np.cumsum([0, *[r["_n"] for r in sizes]]).tolist(), strict=False)}
    shared = spark.sparkContext.broadcast((table, below, first))
    names = [f for f in ordered.schema.fields if f.name not in ("_pid", "_mono")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"

    def assign(batches):
        table, below, first = shared.value
        span = np.int64(1) << 40
        starts = table["length"] * span + table["rank"]
        for b in batches:
            if not b.num_rows:
                continue
            pid, mono = b.column("_pid").to_numpy(), b.column("_mono").to_numpy()
            length = b.column("length").to_numpy()
            pids, which = np.unique(pid, return_inverse=True)
            origin = np.array([first[p] for p in pids.tolist()], dtype=np.int64).reshape(-1, 2)[which]
            rank = mono - origin[:, 0] + origin[:, 1] - below[length]
            at = np.searchsorted(starts, length * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*[b.column(f.name) for f in names],
                 pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])],
                [*[f.name for f in names], "sequence_id", "offset"])

    return map_arrow(ordered, assign, schema)


def assemble(placed: DataFrame) -> DataFrame:
    """The packed sequences: ``ids`` in order of offset, with the pieces' document ids and starts."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (placed.groupBy("sequence_id").agg(parts.alias("p"))
            .select("sequence_id",
                    F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                    F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets")))


def op8_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents; one row a piece with the crc32 of its ids in place of the ids."""
    pieces = token_pieces(docs, tokenizer, capacity)
    # written before the range partitioning of place(), whose sampling would encode everything twice
    narrow = stored(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pack-pieces")
    return place(narrow, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
