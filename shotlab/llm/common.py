"""Helpers shared by the operators: the shared folder, written tables, file access.

Intermediate results that are read more than once are written as Parquet under the
folder named in ``spark.checkpoint.dir``, which all executors and the driver share, so
a lost executor costs a re-read and never a recomputation of the lineage.  Spark deletes
the folder of the application when its JVM ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of local sessions without a shared folder, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``.

    Only a local master may leave the setting unset (tests): it then gets a temporary
    folder.  On a cluster an unset folder is an error, since no local one would do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="shotlab-")
    return application_dir(spark, base)


def application_dir(spark: SparkSession, base: str) -> str:
    """This application's folder below ``base``, with the scheme of its filesystem unless that is
    a mounted folder: a path without a scheme lies on Hadoop's default filesystem, which tasks
    that write files themselves could not tell."""
    root = f"{base.rstrip('/')}/shotlab-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root if fs.getScheme() == "file" else fs.makeQualified(path).toString()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again (cuts the lineage)."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(path: str):
    """(filesystem, path on it) for a file in the shared folder: a mounted folder or any
    store that Arrow's filesystems reach (hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def commit_file(path: str, data_writer) -> None:
    """Writes a file through ``data_writer(stream)`` under an attempt's own name and moves it
    into place, so that a retried or speculative task leaves one whole file."""
    fs, at = open_fs(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    attempt = f"{os.path.dirname(at)}/_{uuid.uuid4().hex}.{os.path.basename(at)}"
    with fs.open_output_stream(attempt, compression=None) as out:
        data_writer(out)
    fs.move(attempt, at)


def tasks_for(spark: SparkSession) -> int:
    """Partitions for a shuffle of derived rows: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_if_null(col: str):
    return F.coalesce(F.col(col), F.lit(""))
