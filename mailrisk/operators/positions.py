"""Global positions in a sort order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def global_position(df: DataFrame, order, out: str = "pos", base: int = 0) -> DataFrame:
    """Attach the row's position (``base``-based) in ``order``.

    Pass only the key columns (see :func:`positions_of`): the sorted frame is
    checkpointed to the shared checkpoint folder, so the per-partition counts
    and the numbering read the same partitioning (and a lost executor does not
    re-sort with other boundaries).  One count per partition -- a tiny table --
    gives offsets by a running sum; a row's position is its partition's offset
    plus its place inside the partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (df.orderBy(*order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mono", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    sizes = ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    running = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.withColumn("_off", F.sum("_n").over(running) - F.col("_n")).drop("_n")
    return (ordered.join(offsets, "_pid")
            .withColumn(out, F.col("_off") + (F.col("_mono") - F.col("_first")) + base)
            .drop("_pid", "_mono", "_first", "_off"))


def positions_of(df: DataFrame, keys, out: str, base: int = 0, order=None) -> DataFrame:
    """``df`` with its rows' positions in ``order`` (columns of ``keys``; default all of them).

    Only the key columns are sorted and checkpointed; the other columns meet
    their position in one join by key.  Where keys repeat (seen on the narrow
    side), rows with equal keys are numbered on from their key's first position.
    """
    keys = list(keys)
    placed = global_position(df.select(*keys), order or [F.col(k) for k in keys], out="_place", base=base)
    first = placed.groupBy(*keys).agg(F.min("_place").alias("_place"), F.count(F.lit(1)).alias("_times"))
    repeats = first.filter("_times > 1").limit(1).count() > 0
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_place")
    on = None
    for i, k in enumerate(keys):
        part = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = part if on is None else on & part
    place = F.col("_place")
    if repeats:
        place = place + F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) - 1
    return df.join(first, on).select(*df.columns, place.alias("_at")).select(
        *[c for c in df.columns if c != out], F.col("_at").alias(out))
