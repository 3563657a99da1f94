"""Spark session and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "postlens", scan_partitions: int | None = None) -> SparkSession:
    """Session with AQE (skew join, partition coalescing) and UTC time; UI off.

    ``shuffle_partitions`` defaults to 2x the local cores for ``local[*]``; on a cluster leave it to
    the deployment (AQE coalesces small partitions at run time).  ``scan_partitions`` spreads tables
    that are stored as one row group (small test tables); leave it out on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if scan_partitions:
        builder = builder.config("postlens.scan.partitions", str(scan_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", "16g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, streaming checkpoints and sinks.

    Uses the folder the cluster names in ``spark.checkpoint.dir``.  Only a ``local`` master, whose
    tasks run on this machine, gets a folder of our own when none is named; on a cluster every
    executor would write to its own disk, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="postlens-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder; the innermost ``scratch_scope`` owns it."""
    path = f"{shared_dir(spark).rstrip('/')}/postlens/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """Owns the intermediate tables that are made inside: they are deleted when it ends, so results
    must have been written by then.  Without a scope they stay, as lazy results still read them.

        with scratch_scope(spark):
            queries()["pipeline"](spark, data).write.parquet(result)
    """
    _scopes.append([])
    try:
        yield
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in _scopes.pop():
            p = hadoop(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that run there."""
    sc = spark.sparkContext
    if getattr(sc, "_postlens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="postlens-zip-"), "postlens.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.join("postlens", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    sc._postlens_shipped = True
