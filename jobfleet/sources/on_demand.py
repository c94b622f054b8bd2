"""Metadata documents fetched by name: only the paths that jobs refer to, each once, without a walk of the export."""

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
import re
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfleet.functions.paths import path_below
from jobfleet.staging import stage, staging_path

BATCH = 1000  # paths that one read names, and that the driver holds at a time for each reader
READERS = 4
DOCUMENT = "path string, content string"


def metadata_paths(jobs: DataFrame) -> DataFrame:
    """``(path)`` of every metadata document that a bundle-managed job names."""
    return jobs.filter(F.col("is_bundle") & (F.col("metadata_path") != "")).select(F.col("metadata_path").alias("path")).distinct()


def named_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame | None:
    """The files of these names below ``root``, whole; None when there is none.

    They are one pattern of alternatives, of which those that do not exist match nothing. Characters that patterns
    use stand for any one character in it, so a few more files may be among the result.
    """
    alternatives = ",".join(re.sub(r"[\\{}\[\]*?,]", "?", name) for name in names)
    pattern = f"{root.rstrip('/')}/{{{alternatives}}}"
    try:
        return spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(pattern, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _batches(paths: DataFrame, prefix: str) -> Iterator[list[str]]:
    rows = (row.path.removeprefix(prefix) for row in paths.toLocalIterator())
    while batch := list(islice(rows, BATCH)):
        yield batch


def fetch_documents(paths: DataFrame, root: str, workspace_root: str = "/Workspace") -> DataFrame:
    """``(path, content, error)`` of each of the ``paths``: its document below the export folder ``root``, or why there is none.

    ``workspace_root`` stands for ``root`` in the paths that jobs name. Work grows with the paths asked for, not with the export.
    """
    spark = paths.sparkSession
    prefix = workspace_root.rstrip("/") + "/"
    paths = stage(paths.select("path").distinct(), "wanted-paths")
    inside = _below(prefix)
    folder = staging_path(spark, "documents")

    def fetch(numbered: tuple[int, list[str]]) -> None:
        number, names = numbered
        files = named_files(spark, root, names)
        if files is not None:
            path = F.concat(F.lit(prefix), path_below(root))
            files.select(path.alias("path"), F.col("value").alias("content")).write.parquet(f"{folder}/{number}-{uuid4().hex}")

    spark.createDataFrame([], DOCUMENT).write.parquet(f"{folder}/none")
    with ThreadPoolExecutor(READERS) as readers:
        waiting = []
        for batch in enumerate(_batches(paths.filter(inside), prefix)):
            waiting.append(readers.submit(fetch, batch))
            if len(waiting) >= 2 * READERS:
                waiting.pop(0).result()
        for task in waiting:
            task.result()
    found = spark.read.schema(DOCUMENT).parquet(f"{folder}/*").dropDuplicates(["path"])
    error = F.when(~inside, F.lit("lies outside the workspace folder")).when(
        F.col("content").isNull(), F.lit("is missing, empty or cannot be read")
    )
    return paths.join(found, "path", "left").withColumn("error", error)


def _below(prefix: str) -> Column:
    """Paths below ``prefix`` without empty, ``.`` or ``..`` parts."""
    rest = F.substring("path", len(prefix) + 1, 1 << 30)
    odd = F.exists(F.split(rest, "/"), lambda part: part.isin("", ".", ".."))
    return F.startswith("path", F.lit(prefix)) & ~odd
