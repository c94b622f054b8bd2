"""Inventory rows of matched jobs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfleet.functions.filters import or_blank
from jobfleet.operators.enrich import enrich_bundles, metadata_columns
from jobfleet.schemas import BUNDLE, DIRECT, HOST, INVENTORY


def inventory_rows(
    matched: DataFrame, scanned_at: Column, metadata: DataFrame | None = None
) -> DataFrame:
    """One row per matched job, no nulls; metadata is joined only when a table is given."""
    path = F.when(F.col("is_bundle"), F.col("metadata_path"))
    return (
        enrich_bundles(matched, metadata)
        .select(
            HOST,
            scanned_at.cast("timestamp").alias("scanned_at"),
            "job_id",
            F.col("job_name").alias("name"),
            or_blank(F.col("creator_user_name")).alias("creator"),
            F.when(F.col("is_bundle"), BUNDLE).otherwise(DIRECT).alias("deployment_kind"),
            *metadata_columns(),
            or_blank(path).alias("metadata_file_path"),
        )
        .select(*INVENTORY.names)
    )
