"""Bundle metadata joined onto jobs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfleet.functions.filters import or_blank
from jobfleet.schemas import JOB_KEY, METADATA_FIELDS

NO_PATHS = 1024


def enrich_bundles(jobs: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Add the seven metadata columns to jobs with facts; null for direct jobs and
    unknown paths.

    Without a metadata table no join is planned. The join carries no hint: a
    metadata table whose size is known to be small is broadcast, and a larger
    one is sort-merged with skewed paths split by adaptive execution. Jobs
    without a path, often half of them, get one of ``NO_PATHS`` keys that no
    document has, so that they do not meet in one task. A path listed twice
    counts once, with the least of its rows.
    """
    if metadata is None:
        return jobs.withColumns({f: F.lit(None).cast("string") for f in METADATA_FIELDS})
    path = F.when(F.col("is_bundle"), F.nullif("metadata_path", F.lit("")))
    no_path = F.concat(F.lit("\0"), F.pmod(F.hash(*JOB_KEY), F.lit(NO_PATHS)))
    path = F.coalesce(path, no_path)
    known = (
        metadata.groupBy(F.col("path").alias("bundle_path"))
        .agg(F.min(F.struct(*METADATA_FIELDS)).alias("fields"))
        .select("bundle_path", "fields.*")
    )
    return (
        jobs.withColumn("bundle_path", path)
        .join(known, "bundle_path", "left")
        .drop("bundle_path")
    )


def metadata_columns() -> list[Column]:
    return [or_blank(F.col(f)).alias(f) for f in METADATA_FIELDS]
