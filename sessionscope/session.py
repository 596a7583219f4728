"""Session options the operators rely on, and the shared working folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import SparkSession

RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot lock object or group key is split even when that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options (no restart needed) and return the session."""
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A session in one process that names none uses its warehouse folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_working"
    return folder.rstrip("/")


def working_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the working folder (nothing is created yet)."""
    return f"{working_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop_working_folder(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no DataFrame reads them any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(working_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df, label: str):
    """Cut the lineage of ``df``: write it to the shared folder and read it back."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(rows, folder: str | None, name: str):
    """Cut the lineage through a table in the caller's folder, if there is one."""
    if folder is None:
        return rows
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what finished queries left behind: their plans in the driver, and their shuffle files.

    Spark drops both when the driver collects garbage, which one with memory to spare puts off, so that
    over the batches of a stream its heap grows to the limit although next to nothing in it is used.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
