"""Intermediate tables written to the shared folder of the session.

A staged table has three uses: it cuts lineage, it is computed once however
often it is read, and its file size is known to the optimizer, so joins with
it are broadcast only when the table really is small.
"""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """This application's part of the session's ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="jobfleet-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/jobfleet-{context.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/{name}-{uuid4().hex}"


def write_staged(df: DataFrame, name: str, partition_by: str | None = None, dealt: bool = False) -> str:
    """Write ``df`` to a new folder and return its path; with ``dealt`` its rows are spread by the partition column already."""
    path = staging_path(df.sparkSession, name)
    if partition_by is None:
        df.write.parquet(path)
    else:
        rows = df if dealt else spread(df, partition_by)
        rows.write.partitionBy(partition_by).parquet(path)
    return path


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = write_staged(df, name, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark finds it on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def clear_staged(spark: SparkSession) -> None:
    """Remove what this application has staged. Tables that read from it can no longer be used."""
    root = spark._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def spread(df: DataFrame, partition_by: str) -> DataFrame:
    """Group rows by the partition column before a partitioned write.

    The rebalance hint lets adaptive execution split a hot partition value
    over many tasks and merge small ones, so neither one task nor a flood of
    small files results.
    """
    return df.hint("rebalance", partition_by)
