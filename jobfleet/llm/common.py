"""Helpers shared by the operators: staging, row keys, local bindings, size-checked broadcasts."""

import math
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK = r"[\x20\x09-\x0D]+"
#: A side is only broadcast when the bytes measured for it are at most this many.
BROADCAST_BYTES = 32 << 20
#: Uncompressed text, in bytes, that one range or repartition task should get.
TASK_BYTES = 16 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it: one without a scheme is on the cluster's default file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Without the setting a local session gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = context.getCheckpointDir()
    folder = qualified(spark, folder)
    return f"{folder.rstrip('/')}/llm-{context.applicationId}/{name}-{uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and scan it from there; cuts lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, whatever ``body`` does with it."""
    return F.transform(F.array(value), body).getItem(0)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def words(text: Column, separators: str = BLANK) -> Column:
    """The words of a text, none of them empty; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    return F.filter(parts, lambda w: w != "")


def text_key(*columns: str) -> Column:
    """A key for a row's content: equal rows share it, and it is never null."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def small(df: DataFrame, bytes_in_memory: int) -> DataFrame:
    """Hint a broadcast when the measured size allows it; else leave the choice to Spark."""
    return F.broadcast(df) if bytes_in_memory <= BROADCAST_BYTES else df


def tasks_for(byte_count: int, each: int = TASK_BYTES, least: int = 1) -> int:
    return max(least, math.ceil(byte_count / each))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller never clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])
