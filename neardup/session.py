"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Spark removes the shuffle files of a query at its end, not when the driver's garbage collector finds them unused.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, app: str = "neardup",
              shuffle_partitions: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """Session with AQE (coalescing + skew join) on and the web UI off.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle-partition count should then be sized to the input (about 128 MB
    per partition), AQE coalesces the small ones at runtime.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cores = os.cpu_count() or 8
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 2 * cores))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", driver_memory))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that setting
    is always used when present. Only a local-mode session without one (tests)
    gets a fresh scratch folder; on a cluster a missing setting is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="neardup-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df):
    """Materialise ``df`` as a Parquet table under the checkpoint dir and read it back.

    Equivalent to a reliable ``checkpoint()`` (shared storage, survives executor
    loss, cuts the lineage) but computes the plan once: ``Dataset.checkpoint``
    runs it a second time to write the files unless it is also cached. The read
    side gets Parquet statistics, column pruning and filter pushdown. Shuffle files of the
    write are removed at its end: only the table is read later.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/neardup-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of ``module_name`` by value inside Python UDFs."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except (ImportError, AttributeError, ValueError):
        pass
