"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder (spark.checkpoint.dir). Where that is unset, a local one in local mode; on a cluster an error, as executors wouldn't see it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="pilefold-")
        base = _own[app]
    return f"{base.rstrip('/')}/pilefold/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder, in a folder for each value of `by`, and read again: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that saved() made and that no later step reads."""
    files = df.inputFiles()
    if files:
        where = files[0].rpartition("/")[0]
        remove(df.sparkSession, where.rpartition("/")[0] if "=" in where.rpartition("/")[2] else where)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
