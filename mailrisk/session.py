"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "mailrisk", master: str | None = None,
                shuffle_partitions: int | None = None, checkpoint_dir: str | None = None) -> SparkSession:
    """Return the active session, or build a local one (tests, bench).

    On a cluster the session comes from ``spark-submit``; the settings here
    only apply when no session exists yet.  ``checkpoint_dir`` defaults to a
    folder of this machine's own, which a local session's tasks share.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.appName(app)
         .master(master or f"local[{cpus}]")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="mailrisk-ckpt-"))
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}  # application id -> folder, for local sessions without the setting


def _base(spark: SparkSession) -> str:
    """The cluster's shared folder ``spark.checkpoint.dir``, read from the session.

    A local session without the setting (tests) gets a folder of its own, since its
    tasks run on this machine; on a cluster a machine-local folder would be lost
    with its executor, so the missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="mailrisk-ckpt-")
    return _LOCAL[sc.applicationId]


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder."""
    return f"{_base(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows may read it often, its lineage runs once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable: the context's folder follows the session setting."""
    base = _base(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base
