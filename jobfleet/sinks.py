"""Writers of inventories, reports and the removal log."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobfleet.schemas import (
    BUNDLE_REPORT_COLUMNS,
    HOST,
    INVENTORY,
    INVENTORY_CSV_COLUMNS,
    REMOVAL_LOG,
    SESSION_VIEW,
)
from jobfleet.sources.snapshots import evolved_schema
from jobfleet.staging import spread


# Empty strings leave nothing between the commas, quotes are doubled, blanks are kept.
CSV_FORMAT = {
    "header": True,
    "emptyValue": "",
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _write_csv(rows: DataFrame, path: str, columns: tuple[str, ...]) -> bool:
    if not path or rows.isEmpty():
        return False
    rows.select(*columns).write.mode("overwrite").options(**CSV_FORMAT).csv(path)
    return True


def write_inventory_csv(inventory: DataFrame, path: str) -> bool:
    """Twelve-column CSV; nothing is written without a path or without rows."""
    return _write_csv(inventory, path, INVENTORY_CSV_COLUMNS)


def write_bundle_report_csv(report: DataFrame, path: str) -> bool:
    """Eleven-column CSV of bundle-managed jobs, under the same rule."""
    return _write_csv(report, path, BUNDLE_REPORT_COLUMNS)


class SchemaConflict(ValueError):
    """Rows to be written have a column that the table knows with another type."""


def _check_columns(rows: DataFrame, path: str, known: T.StructType) -> None:
    """New columns may widen a table; those it has keep their types, in all parts and in ``known``."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    has_rows = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    try:
        table = evolved_schema(spark, path, known) if has_rows else known
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":  # a folder without parts
            raise
        table = known
    types = {f.name.lower(): (f.name, f.dataType.simpleString()) for f in table.fields}
    for field in rows.schema.fields:
        name, kind = types.get(field.name.lower(), (field.name, field.dataType.simpleString()))
        if (name, kind) != (field.name, field.dataType.simpleString()):
            raise SchemaConflict(f"{path} has {name} as {kind}; the rows have {field.name} as {field.dataType.simpleString()}")
    if HOST not in rows.columns:
        raise SchemaConflict(f"rows for {path} need {HOST}, by which the table is partitioned")


def overwrite_inventory(inventory: DataFrame, path: str) -> None:
    """Replace the partitions of the workspaces that have rows; keep all others.

    A workspace scanned with a filter keeps only the rows that passed it, and
    one without rows keeps its old partition. Rows may have more columns than older
    partitions, whose rows then have nulls there.
    """
    _check_columns(inventory, path, INVENTORY)
    (
        spread(inventory, HOST)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(HOST)
        .parquet(path)
    )


def append_removal_log(records: DataFrame, path: str) -> None:
    """Add rows to the log; earlier rows are never touched. More columns than earlier rows have are allowed."""
    _check_columns(records, path, REMOVAL_LOG)
    spread(records, HOST).write.mode("append").partitionBy(HOST).parquet(path)


def create_session_view(inventory: DataFrame, failures: DataFrame | None = None) -> bool:
    """Expose inventory rows as a session view; not without rows, nor after failures."""
    if failures is not None and not failures.isEmpty():
        return False
    if inventory.isEmpty():
        return False
    inventory.createOrReplaceTempView(SESSION_VIEW)
    return True
