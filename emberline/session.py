"""Session defaults, durable intermediate results and loud guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class DataError(ValueError):
    """Input that breaks a rule the operators must not silently repair."""


def session(master: str | None = None, partitions: int | None = None, app: str = "emberline") -> SparkSession:
    """A session with the settings every operator assumes (UTC days, adaptive plans)."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.sources.partitionOverwriteMode", "dynamic"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = b.getOrCreate()
    broadcast_by_measure(spark)
    parts_by_measure(spark)
    return spark


def broadcast_by_measure(spark: SparkSession) -> None:
    """Leave the choice of a broadcast join to the size a shuffle has measured; an explicit broadcast() stays one.

    The size a plan is given beforehand is that of the file: it counts no row an explode adds, so a compressed table of 8 MB that
    becomes millions of rows would be gathered on the driver. The limit itself stays as configured.
    """
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(static) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(static))
        spark.conf.set(static, "-1")


FIRST_PARTS, JOINED_SIZE = 400, "16m"


def parts_by_measure(spark: SparkSession) -> None:
    """Let adaptive execution cut a shuffle finely and join parts up to 16 MB, so that a task's share stops growing there.

    It only ever joins parts: with the configured number alone, a dozen say, each would grow with the input. Cell rows compress to some
    ten bytes, so Spark's own 64 MB would be six million rows to sort in one task. What was configured stays.
    """
    adaptive = "spark.sql.adaptive."
    if spark.conf.get(adaptive + "coalescePartitions.initialPartitionNum", None) is None:
        spark.conf.set(adaptive + "coalescePartitions.initialPartitionNum", str(max(FIRST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if spark.conf.get(adaptive + "advisoryPartitionSizeInBytes", None) is None:
        spark.conf.set(adaptive + "advisoryPartitionSizeInBytes", JOINED_SIZE)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall back to a scratch folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise DataError("spark.checkpoint.dir must name a shared folder on a cluster")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, next to the checkpoints."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a checkpoint that outlives any executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def require_none(bad: DataFrame, message: str, show: int = 3) -> None:
    """Raise when `bad` has any row; at most `show` rows reach the driver, as evidence."""
    rows = bad.limit(show).collect()
    if rows:
        raise DataError(f"{message}: " + "; ".join(str(r.asDict(recursive=True)) for r in rows))


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DataError(f"missing required column(s): {', '.join(missing)}")
