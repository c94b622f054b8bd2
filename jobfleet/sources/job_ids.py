"""Explicit job ids: literal lists and id files."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobfleet.sources.quoted import first_cells
from jobfleet.staging import stage

# An integer as a cell may spell it, and white space to trim.
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
EDGES = r"(?U)^[\s\x{FEFF}]+|\s+$"


class BadJobIds(ValueError):
    """An id file has a bad cell or no ids at all."""


def _plain_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, start, line, cell)`` of files whose records are lines."""
    return spark.read.schema("cell string").csv(path, header=False, escape='"').select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        "cell",
    )


def read_first_column(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """``(pos, cell, file)`` of text or CSV files: trimmed first cells, blank ones left out.

    With ``multi_line`` quoted cells may hold line breaks, as in an inventory
    CSV. Either way a large file is read by many tasks.

    ``pos`` counts records in file order. Each input split numbers its own lines;
    the counts of the few splits then give every split its offset.
    """
    if multi_line:
        cells = first_cells(spark, path).select("file", F.lit(0).cast("long").alias("start"), F.col("record").alias("line"), "cell")
    else:
        cells = _plain_cells(spark, path)
    lines = stage(cells.withColumn("cell", F.regexp_replace("cell", EDGES, "")), "id-lines")
    splits = lines.groupBy("file", "start").agg(
        F.min("line").alias("first"), (F.max("line") - F.min("line") + 1).alias("size")
    )
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        splits.select(
            "file", "start", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")
        ),
        "id-offsets",
    )
    numbered = lines.join(offsets, ["file", "start"]).withColumn(
        "pos", F.col("line") - F.col("first") + F.col("offset")
    )
    return numbered.filter(F.col("cell") != "").select("pos", "cell", "file")


def load_job_ids(
    spark: SparkSession, path: str | list[str], multi_line: bool = False
) -> DataFrame:
    """``(job_id, pos)`` from the first column of one or more files.

    The first non-blank row of a file may be a header, so an exported inventory,
    a folder of CSV parts, can be given. Any other cell that is no integer, and
    files without ids, are errors.
    """
    cells = read_first_column(spark, path, multi_line)
    number = F.regexp_replace("cell", "_", "").try_cast("bigint")
    parsed = cells.withColumn("job_id", F.when(F.col("cell").rlike(INTEGER), number))
    # One row per file: where it starts, and its first bad cell after that.
    bad = F.when(F.col("job_id").isNull(), F.struct("pos", "cell"))
    starts = parsed.groupBy("file").agg(F.min("pos").alias("first"), F.count("job_id").alias("ids"))
    starts = stage(starts, "id-files")  # few rows, so that the cells are not shuffled by file to meet them
    later = parsed.join(starts, "file").filter(F.col("pos") > F.col("first")).select(bad.alias("bad"))
    wrong = later.agg(F.min("bad").alias("bad")).first()["bad"]
    if wrong is not None:
        raise BadJobIds(f"{path} has a cell that is no whole number: {wrong['cell']!r}")
    if not starts.agg(F.sum("ids")).first()[0]:
        raise BadJobIds(f"{path} lists nothing")
    return parsed.filter(F.col("job_id").isNotNull()).select("job_id", "pos")


def merge_job_ids(
    spark: SparkSession, explicit: Sequence[int] = (), from_file: DataFrame | None = None
) -> DataFrame:
    """Explicit ids first, then file ids; each id once, at its first position."""
    given = spark.createDataFrame(
        [(int(job_id), pos) for pos, job_id in enumerate(explicit)], "job_id long, pos long"
    )
    if from_file is not None:
        moved = from_file.select("job_id", (F.col("pos") + len(explicit)).alias("pos"))
        given = given.unionByName(moved)
    return stage(given.groupBy("job_id").agg(F.min("pos").alias("pos")), "job-ids")
