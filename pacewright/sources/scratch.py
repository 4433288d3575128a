"""The folder that the driver and all executors share, for tables between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where the session names none and all of Spark runs in one process, a temporary folder is made and named
    in the session, so that later calls use the same one; on a cluster that is an error, since executors
    would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="pacewright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder by the file system it lies in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The folders that this process has written and not deleted, with the tables of the catalogue that lie in them.
_WRITTEN: dict[str, str | None] = {}


def own_folder(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new folder for ``name``, which ``clear`` deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = table
    return path


def clear(spark: SparkSession) -> int:
    """Deletes all tables between steps that were written so far; call it when the results that read them are done with."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path, table = _WRITTEN.popitem()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        removed(spark, path)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, for what is read more than once."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
