"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none and runs on this machine alone, a folder made once."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tallyglass.scratch.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyglass-")
        spark.conf.set("tallyglass.scratch.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read back; survives the loss of executors.

    The table goes when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tallyglass-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what settle() wrote for df; nothing that is still to run may read it."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._settled)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
