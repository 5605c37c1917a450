"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; the cluster's own settings stay in force."""
    builder = (
        SparkSession.builder.appName("starpath")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="starpath-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return configured or context.getCheckpointDir()


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for what one run writes; it is removed when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/starpath-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release_unused(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the stored blocks and shuffle files of what no longer has a reference.

    The cleaner acts when the driver's JVM collects garbage, which a busy loop of fits may put off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Lets Spark delete the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def set_down(df: DataFrame, name: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder: as ``cut_lineage``, but for large frames.

    Columns are packed, and the shuffle files of what led here go when the table is written, not when the driver
    happens to collect garbage. So the disk holds the table and one step's shuffles. ``by`` names columns whose values
    get a folder each, which a filter on them reads alone.
    """
    spark = df.sparkSession
    path = run_folder(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def together(frames: list[DataFrame]) -> DataFrame:
    """The rows of all ``frames``, which have the same columns."""
    return reduce(DataFrame.unionByName, frames)
