"""Session helpers: building a local session for tests/bench and cutting lineage.

On a cluster the session is created by the platform; library code only reads
settings from it.  ``materialize`` writes an intermediate table into the shared
folder named by ``spark.checkpoint.dir`` so that later stages (many model fits,
several aggregates over the same windows) re-read columnar parquet instead of
recomputing a long lineage, and survive the loss of executors.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Shared defaults for the local session used by tests and the bench.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "hourloom", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (local mode, UI off, UTC)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("HOURLOOM_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if any."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    return root or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder.  Only a local session without one gets a folder
    of its own, under its warehouse folder; a cluster session must name a
    shared one, because executors cannot read each other's disks."""
    root = checkpoint_root(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    A written table (rather than ``localCheckpoint``) keeps the data on shared
    storage, so a lost executor does not lose it, and re-reads get column
    pruning, filter push-down and a known size (Spark then broadcasts a small
    table by itself).  ``release`` removes the table again.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/hourloom/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def release(df: DataFrame) -> None:
    """Remove a table written by ``materialize``, given as returned."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/hourloom/" in folder:
            remove(df.sparkSession, folder)


def _at(spark: SparkSession, path: str):
    """(file system, path) of a name in whatever store it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _at(spark, old)
    if not fs.rename(at, _at(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")
