"""Session settings and the one way lineage is cut."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings a job should start with. AQE converts joins to broadcast from the
# measured size of a finished stage and splits skewed join partitions; the
# force flag lets it split even when the next operator reuses the key.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "threadloom", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**RECOMMENDED_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def drop_used_shuffles(spark: SparkSession) -> None:
    """Have Spark remove a query's shuffle files when the query ends.

    Jobs of many steps would otherwise keep the files of all steps on disk until
    the driver's garbage collector finds them. It holds for frames made after
    this call; a frame that is run again shuffles again.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; fall back only in local mode."""
    sc = spark.sparkContext
    drop_used_shuffles(spark)
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read on from there.

    Used where a loop would grow its plan, or where several branches read one
    expensive table. The files survive the loss of any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def loose(reduced: DataFrame) -> DataFrame:
    """Take a reduced side out of its partitioning before it is joined on its key.

    A side that is aggregated by the join key already lies as the join wants it,
    so it enters without an exchange of its own, and AQE splits a hot key of the
    other side only between two plain exchanges. The rows moved once more are the
    reduced ones.
    """
    n = reduced.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return reduced.repartition(int(n))


def spread(scan: DataFrame) -> DataFrame:
    """Give a file scan at least one partition per core.

    Small, gzipped or single-block files come as one split, and text work on
    them would run in one task. A scan that has enough splits is left alone.
    Only for scans: counting partitions plans the input but must not run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application.

    Needed where workers run functions of the package and it isn't installed on
    the executors. The archive is sent by Spark's own file service.
    """
    sc = spark.sparkContext
    drop_used_shuffles(spark)
    if getattr(sc, "_threadloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="spark-")
    root = Path(__file__).resolve().parent
    sc.addPyFile(shutil.make_archive(f"{folder}/threadloom", "zip", root.parent, root.name))
    sc._threadloom_shipped = True
