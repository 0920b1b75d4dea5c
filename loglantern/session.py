"""Session settings shared by the bench and the tests, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "loglantern", memory: str = "16g") -> SparkSession:
    """A single-machine session; on a cluster the caller brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # the JVM never compiles larger methods; Spark then splits the work itself
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # line rules cost more than the bytes they read: keep all cores busy on small inputs
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for data that must outlive an executor.

    Only where the session names none (tests on one machine) a new temporary
    folder is made; a cluster that names none is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="loglantern-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for tables that are written and read back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(rows: DataFrame) -> DataFrame:
    """Write rows to the shared folder once, for readers that come back to them many times."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def spread(rows: DataFrame) -> DataFrame:
    """Deal a table that arrives in fewer parts than there are cores over all of them.

    Tables of many files stay as they are: only a small one, where the work per row outweighs
    its bytes, is shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
