"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "trailfold") -> SparkSession:
    """A session tuned for this library.

    A session that is already there keeps its settings; only the session
    time zone, on which results depend, is set.  A new session on a cluster
    takes what ``spark-submit`` gives it and Spark's defaults for the rest.  A
    new ``local`` one (tests, bench) gets a few shuffle partitions, as the
    machine has few cores, unless ``shuffle_partitions`` says otherwise.
    """
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        if master and master.startswith("local"):
            builder = (builder.config("spark.driver.memory", os.environ.get("TRAILFOLD_DRIVER_MEMORY", "16g"))
                       .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
                       .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
            if not shuffle_partitions:
                builder = builder.config("spark.sql.shuffle.partitions",
                                         os.environ.get("TRAILFOLD_SHUFFLE_PARTITIONS", "8"))
        spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Pin the session settings the operators rely on (idempotent)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # a reply that repeats a key is valid; its last value counts
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir`` (a shared filesystem such
    as HDFS or an object store); we read it from the session.  Only a
    ``local`` master without the setting — tests — gets a scratch folder of
    our own; elsewhere a machine's own folder would be lost with it, so the
    setting is required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="trailfold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df):
    """Reliable checkpoint computed once.

    An eager ``checkpoint()`` of an unpersisted Dataset runs its plan twice
    (one job to count, one to write the files).  Persisting first lets the
    write read the cached blocks; the cache is dropped once the checkpoint
    files exist, so memory is not held and lineage is cut to the shared
    checkpoint folder.
    """
    from pyspark import StorageLevel
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
