"""Shared Spark helpers of the subpackage: tables, shared folders, sorted runs."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (any store that Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that every executor sees, so a lost executor
    costs only the tasks of the stage that is running.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that :func:`stored` returned and nobody reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of_id(col: str = "doc_id") -> Column:
    """Unsigned crc32 of the id's decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns renamed ``_0, _1, ...`` by position, and their names.

    Whatever extra columns a table has, their names can neither clash with one another
    nor with what an operator adds.
    """
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), df.columns


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Only the columns a job reads, by exact name; all others are left behind."""
    plain, names = numbered(df)
    return plain.select(*[F.col(f"_{names.index(c)}").alias(c) for c in cols])


def widened(df: DataFrame, keep: list[str], ddl: str) -> T.StructType:
    """Schema of the ``keep`` columns of ``df`` and the columns of ``ddl``."""
    return T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(ddl).fields])


def running_total(df: DataFrame, order: str, value: str, out: str, group: int = 4096) -> DataFrame:
    """``out`` = sum of ``value`` over the rows with a smaller ``order`` (a dense number from 0).

    Two levels: sums of groups of 4096 neighbours, then inside each group, so no
    window sees more than the group sums or one group's rows.
    """
    from pyspark.sql import Window

    grouped = df.withColumn("_grp", F.floor(F.col(order) / group))
    sums = grouped.groupBy("_grp").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_grp").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_grp", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_grp").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (grouped.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(sums, "_grp")
            .withColumn(out, (F.col("_base") + F.col("_in")).cast("long"))
            .drop("_grp", "_in", "_base"))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream sorted by ``keys``: tables of complete groups with their bounds.

    Yields ``(table, bounds)`` where group ``i`` is ``table[bounds[i]:bounds[i + 1]]``.
    Only the group at the end of a batch waits for the next one.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([*waiting, batch]).combine_chunks()
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if not len(starts):
            waiting.append(batch)
            continue
        yield t.slice(0, starts[-1]), np.concatenate(([0], starts))
        waiting = t.slice(starts[-1]).to_batches()
    if waiting:
        t = pa.Table.from_batches(waiting).combine_chunks()
        yield t, np.array([0, t.num_rows])


def block_pairs(members: DataFrame, group: str, member: str, size: int, weight: Column | None = None) -> DataFrame:
    """Members of each group, dealt into tasks that each hold two blocks of the group.

    A group of at most ``size`` (sum of ``weight``, default one a member) stays one
    block.  A larger one is dealt by a hash into blocks of about that size, and every
    pair of blocks becomes a task of its own (``_i <= _j``): all pairs of members meet
    in some task, none is emitted, and no task holds more than two blocks.
    """
    w = weight if weight is not None else F.lit(1)
    sizes = (members.groupBy(group).agg(F.sum(w).alias("_w"), F.count(F.lit(1)).alias("_m"))
             .filter("_m > 1")
             .select(group, F.ceil(F.col("_w") / size).cast("int").alias("_nb")))
    dealt = (members.join(sizes, group)
             .withColumn("_b", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))))
    return (dealt.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))
            .drop("_nb", "_o"))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"  # set here only where the session leaves it unset


def ship_code(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, so Python tasks can import it there."""
    sc = spark.sparkContext
    if getattr(sc, "_mailrisk_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="mailrisk-code-")) / "mailrisk-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))  # served by the driver, not read from a shared folder
    sc._mailrisk_shipped = True


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` by a function of this package, in batches of bounded bytes however long the texts are."""
    ship_code(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(BATCH_BYTES, "4m")
    return df.mapInArrow(fn, schema)
