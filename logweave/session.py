"""Session helpers: a tuned builder for tests/bench and a checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "logweave") -> SparkSession:
    """Local/test session.  On a cluster pass the cluster master instead.

    AQE is on so shuffle partitions coalesce for small stages and skewed
    join partitions are split at run time.
    """
    master = master or os.environ.get("LOGWEAVE_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("LOGWEAVE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Regex-heavy text stages are CPU-bound per byte: let AQE coalesce to about
        # size/parallelism instead of a 1 MB floor (large inputs are unaffected).
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
        # (measured: lowering spark.sql.codegen.hugeMethodLimit to 8000 made the
        # headline queries ~40% slower, so Spark's default is kept)
        .config("spark.sql.codegen.hugeMethodLimit", os.environ.get("LOGWEAVE_HUGE_METHOD_LIMIT", "65535"))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOGWEAVE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; a folder of our own is only set when
    the session has none and its master is local (tests, local runs); elsewhere
    a machine-local folder would be unreadable, so a missing setting is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="logweave-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> str:
    """Send this package to the executors as a zip (needed where it isn't installed on them).

    The zip is written once to a folder of the driver; ``addPyFile`` copies it to every worker.
    """
    import shutil
    folder = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="logweave-zip-"), "logweave")
    path = shutil.make_archive(base, "zip", os.path.dirname(folder), os.path.basename(folder))
    spark.sparkContext.addPyFile(path)
    return path
