"""Connected components of a distributed edge list: local contraction and pointer jumps.

Every task first replaces the edges it holds, piece by piece, by stars around the smallest
id of each piece's components; then no node is the larger end of more than one edge a
piece, so dealing the edges by their larger end sends no node's edges in bulk to one task.
There they are contracted again, which links all smaller neighbours of a node.  Then
every edge's smaller end is replaced by that end's own smallest neighbour, if smaller.
Both steps keep what is connected connected and only ever put smaller ids in, until all
components are stars.  A round takes one query over the edges and one over their ends; both
are written to the shared folder.  Only whether a round was the last reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_arrow, sorted_runs, stored

PIECE = 1 << 18  # edges contracted at once


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(id, smallest id of its component)`` of all ends of the edges that are not that id themselves."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contract(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Stars of at least ``PIECE`` edges at a time; pieces that shrink well take in more before they go out."""
    held, rows = [], 0

    def star():
        return stars(*(np.concatenate(x) for x in zip(*held, strict=True)))

    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows >= PIECE:
            held = [star()]
            rows = len(held[0][0])
            if rows > PIECE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                held, rows = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in star()], ["a", "b"])


def _gathered(edges: DataFrame) -> DataFrame:
    """Contracted edges ``a > b``; all edges with the same larger end were contracted together."""

    def apart(batches):
        return _contract((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)

    def together(batches):  # the edges of a larger end lie in one part
        return _contract((t.column("a").to_numpy(), t.column("b").to_numpy()) for t, _ in sorted_runs(batches, ["a"]))

    dealt = map_arrow(edges.select("a", "b"), apart, "a long, b long").repartition("a").sortWithinPartitions("a")
    return stored(map_arrow(dealt, together, "a long, b long"), "edges")


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of the edges ``(a, b)`` with two different ends; the component is its smallest id."""
    now = _gathered(edges.filter("a != b"))
    while True:
        ends = now.select(F.col("a").alias("id"), F.col("b").alias("to"), F.lit(False).alias("inner")).unionByName(
            now.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("inner")))
        nodes = stored(ends.groupBy("id").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.max("inner").alias("inner")), "nodes")
        if nodes.filter("least != most OR (least IS NOT NULL AND inner)").isEmpty():
            drop_stored(now)
            return nodes.select("id", F.coalesce("least", "id").alias("component"))
        up = nodes.filter("least IS NOT NULL AND inner").select(F.col("id").alias("b"), F.col("least").alias("up"))
        then = _gathered(now.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b")))
        drop_stored(now)
        drop_stored(nodes)
        now = then
