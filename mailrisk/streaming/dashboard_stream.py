"""Running dashboard totals and per-domain counts over the history's versions.

The stream reads the history's commits.  Each says which segments of rows came and which went,
so a micro-batch counts only those, with the sign, and merges them by domain key into the counts
of the version before; work does not depend on how many batches the history has.  A replayed
batch, a deletion and a rewritten segment are a segment that goes and one that comes.  A
compaction moves rows without changing them and is passed over.

``last``, the newest detection of a domain (H7 orders ties by it), only grows with what comes.
Where what went held the newest one, it is taken anew from the history, for those domains alone.

Results are versions: a reader sees the last complete one.  A micro-batch that is run again starts
from the version before its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schema as SC
from ..operators.history import domain_key
from ..sources import paths
from ..sources import table_log as L

COUNTS = "domain string, spam long, ham long, last timestamp"


def counted(history: DataFrame, sign: int = 1) -> DataFrame:
    """Signed spam/ham counts and the newest detection per domain key."""
    is_spam = F.col("classification") == K.SPAM
    return (history.select(domain_key(F.col("sender")).alias("domain"), "classification", "created_at").groupBy("domain")
            .agg((F.count_if(is_spam) * sign).alias("spam"), (F.count_if(~is_spam | F.col("classification").isNull()) * sign).alias("ham"),
                 F.max("created_at").alias("last")))


def net_changes(changes: list[L.Change]) -> tuple[list[str], list[str]]:
    """Segments that came and that went over several commits; those that came and went again count for nothing.

    Compactions are passed over: the segments they merged can still be read, and where a merged
    segment goes later, it takes away just what those brought.
    """
    came: list[str] = []
    went: list[str] = []
    for c in changes:
        if c.operation != "compact":
            went += [s for s in c.remove if s not in came]
            came = [s for s in came if s not in c.remove] + list(c.add)
    return came, went


def merged(before: DataFrame, history: L.TableLog, came: list[str], went: list[str], version: int) -> DataFrame:
    """Counts after the segments ``came`` and ``went``; ``version`` is the history's version then."""
    plus = counted(history.read(SC.HISTORY, came))
    if not went:
        both = before.unionByName(plus)
        return both.groupBy("domain").agg(F.sum("spam").alias("spam"), F.sum("ham").alias("ham"), F.max("last").alias("last"))
    minus = counted(history.read(SC.HISTORY, went), -1).withColumnRenamed("last", "gone").withColumn("last", F.lit(None).cast("timestamp"))
    parts = before.unionByName(plus).withColumn("gone", F.lit(None).cast("timestamp")).unionByName(minus)
    now = parts.groupBy("domain").agg(*[f(c).alias(c) for f, c in ((F.sum, "spam"), (F.sum, "ham"), (F.max, "last"), (F.max, "gone"))])
    now = now.filter(F.col("spam") + F.col("ham") > 0)
    lost = now.filter(F.col("gone") >= F.col("last")).select("domain")  # their newest detection may be among what went
    rows = history.read(SC.HISTORY, history.snapshot(version).segments)
    newest = (rows.select(domain_key(F.col("sender")).alias("domain"), "created_at").join(lost, "domain", "left_semi")
              .groupBy("domain").agg(F.max("created_at").alias("again")))
    last = F.when(F.col("gone") >= F.col("last"), F.col("again")).otherwise(F.col("last"))
    return now.join(newest, "domain", "left").select("domain", "spam", "ham", last.alias("last"))


def _versions(spark: SparkSession, out_dir: str) -> list[int]:
    return [int(f.split("=")[1]) for f in paths.folders(spark, out_dir) if f.startswith("version=") and paths.exists(spark, f"{out_dir}/{f}/_SUCCESS")]


def _folder(out_dir: str, version: int) -> str:
    return f"{out_dir}/version={version:010d}"


def h7_order() -> list[Column]:
    return [(F.col("spam") + F.col("ham")).desc(), F.col("last").desc_nulls_last(), F.col("domain").asc()]


def read_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """Counts and newest detection per domain of the last complete version."""
    done = _versions(spark, out_dir)
    if not done:
        raise FileNotFoundError(f"no dashboard version in {out_dir}")
    return spark.read.schema(COUNTS).parquet(_folder(out_dir, max(done)))


def read_dashboard(spark: SparkSession, out_dir: str) -> DataFrame:
    """H7 (domain, spam, ham) of the last complete version, in H7's order: by total, ties by the newest detection."""
    return read_counts(spark, out_dir).orderBy(*h7_order()).drop("last")


def read_ranked(spark: SparkSession, out_dir: str) -> DataFrame:
    """H7 with each domain's 1-based place in its order."""
    from ..operators.positions import global_position
    return global_position(read_counts(spark, out_dir), h7_order(), out="place", base=1).select("place", "domain", "spam", "ham")


def dashboard_totals(dashboard: DataFrame) -> DataFrame:
    """H6 from the per-domain counts: total, spam, not_spam."""
    return dashboard.agg(F.coalesce(F.sum(F.col("spam") + F.col("ham")), F.lit(0)).alias("total"),
                         F.coalesce(F.sum("spam"), F.lit(0)).alias("spam"),
                         F.coalesce(F.sum("ham"), F.lit(0)).alias("not_spam"))


def apply_commits(spark: SparkSession, history_dir: str, out_dir: str, commits: list[str], batch_id: int) -> None:
    """Write version ``batch_id`` of the dashboard: the one before it and the given commits (their JSON text)."""
    history = L.TableLog(spark, history_dir)
    numbered = sorted((L.version_of(c), L.parse_change(c)) for c in commits)
    came, went = net_changes([c for _, c in numbered])
    earlier = [v for v in _versions(spark, out_dir) if v < batch_id]
    before = spark.read.schema(COUNTS).parquet(_folder(out_dir, max(earlier))) if earlier else spark.createDataFrame([], COUNTS)
    version = numbered[-1][0] if numbered else 0
    merged(before, history, came, went, version).write.mode("overwrite").parquet(_folder(out_dir, batch_id))
    for old in sorted(earlier)[:-1]:  # one version stays beside the newest, for readers and a repeated micro-batch
        paths.delete(spark, _folder(out_dir, old))


def start_dashboard_stream(spark: SparkSession, history_dir: str, out_dir: str, checkpoint_dir: str,
                           available_now: bool = True):
    paths.make_folder(spark, f"{history_dir.rstrip('/')}/commits")
    commits = spark.readStream.schema("value string").option("wholetext", True).text(f"{history_dir.rstrip('/')}/commits")

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_commits(spark, history_dir, out_dir, [r[0] for r in batch.collect()], batch_id)  # only commits that are new

    w = commits.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
