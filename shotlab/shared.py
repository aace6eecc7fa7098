"""Tables in the folder that all executors share.

A result that many later jobs read is written there and read again: its plan becomes a scan, and a
lost executor costs a re-read.  Spark deletes the folder of the application when it ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; only a local master may leave that
    unset (tests) and then gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shotlab-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/shotlab-{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Written(list):
    """A ``keep`` list for experiments of many queries: operators write what they would persist.

    The plan of a persisted table is part of the plan of each query over it, nested ones again and
    again, and the driver holds and reports them all; that of a table is a scan."""


def held(df: DataFrame, keep: list | None) -> DataFrame:
    """``df`` persisted and listed in ``keep``, whose owner frees it; written for a ``Written`` one."""
    if isinstance(keep, Written):
        return settled(df, "kept")
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if keep is not None:
        keep.append(df)
    return df


def step(df: DataFrame, keep: list | None) -> DataFrame:
    """``df``, written for a ``Written`` list: a query of its own."""
    return settled(df, "step") if isinstance(keep, Written) else df
