"""Job snapshots, destination pages, bundle metadata, inventory and removal log."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobfleet.functions.paths import path_below
from jobfleet.functions.variants import is_object, strict_json, value_at
from jobfleet.schemas import (
    DESTINATION_PAGES,
    HOST,
    INVENTORY,
    JOBS,
    METADATA_FIELDS,
    REMOVAL_LOG,
)


def read_jobs(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Job snapshots of all workspaces, with the schema given rather than inferred."""
    return spark.read.format(format).schema(JOBS).load(path)


def read_destination_pages(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return spark.read.format(format).schema(DESTINATION_PAGES).load(path)


def scan_destinations(pages: DataFrame) -> DataFrame:
    """All listed destinations in list order; a page may have null results.

    ``ordinal`` is the page number and the place on the page in one integer.
    A listing is whole when its last page names no further one; ``cut_listings``
    has the workspaces where that is not so.
    """
    listed = pages.select(HOST, "page", F.posexplode("results").alias("place", "result"))
    ordinal = F.shiftleft(F.col("page"), 32) + F.col("place")
    return listed.select(
        HOST, ordinal.alias("ordinal"), "result.id", "result.display_name", "result.destination_type"
    )


def read_metadata_documents(spark: SparkSession, root: str, workspace_root: str = "/Workspace") -> DataFrame:
    """``(path, content)`` of the metadata files below an export folder, one row per file.

    ``path`` is what a job's deployment names: the export folder's place is
    taken by ``workspace_root``.
    """
    whole = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    path = F.concat(F.lit(workspace_root.rstrip("/") + "/"), path_below(root))
    return whole.select(path.alias("path"), F.col("value").alias("content"))


def cut_listings(pages: DataFrame) -> DataFrame:
    """Workspaces whose listing is not whole.

    Every page is held against the one after it: a page that names a next one must have it, asked for with that very token
    where the pages say so, and the last page names none. Pages that are there twice, and a first page
    that was asked for with a token, break a listing too.
    """
    token = F.coalesce("next_page_token", F.lit(""))
    asked = F.col("page_token") if "page_token" in pages.columns else F.lit(None).cast("string")
    links = pages.groupBy(HOST, "page").agg(
        F.count(F.lit(1)).alias("n"), F.min(token).alias("names"), F.min(F.nullif(asked, F.lit(""))).alias("asked")
    )
    after = links.select(HOST, (F.col("page") - 1).alias("page"), F.lit(True).alias("is_there"), F.col("asked").alias("asked_next"))
    joined = links.join(after, [HOST, "page"], "full")
    there, names = F.coalesce("is_there", F.lit(False)), F.coalesce("names", F.lit(""))
    other = F.coalesce(F.col("asked_next") != names, F.lit(False))
    # rows without ``n`` stand before the first page, or in a gap; a listing has one of them
    fault = F.when(F.col("n").isNull(), F.col("asked_next").isNotNull()).otherwise((F.col("n") > 1) | ((names != "") != there) | (there & other))
    told = joined.groupBy(HOST).agg(F.bool_or(fault).alias("fault"), F.count_if(F.col("n").isNull()).alias("starts"))
    return told.filter(F.col("fault") | (F.col("starts") > 1)).select(HOST)


class CutListings(ValueError):
    """Some workspaces' destination listings are not whole."""


def require_whole_listings(pages: DataFrame) -> None:
    cut = cut_listings(pages)
    count = cut.count()
    if count:
        some = [row[HOST] for row in cut.orderBy(HOST).limit(20).collect()]
        raise CutListings(f"{count} destination listing(s) break off, such as those of {some}")


def whole_destinations(pages: DataFrame) -> DataFrame:
    """The destinations of listing pages, after a check that every listing is whole."""
    require_whole_listings(pages)
    return scan_destinations(pages)


def _first(document: Column, *paths: str) -> Column:
    values = [F.nullif(value_at(document, path, "string"), F.lit("")) for path in paths]
    return F.coalesce(*values)


def bundle_metadata(documents: DataFrame) -> DataFrame:
    """The seven metadata fields of each document.

    Fields are read from ``config`` where that is an object, else from the
    document itself. Malformed documents and non-objects give nulls.
    """
    parsed = documents.select("path", strict_json(F.col("content")).alias("doc"))
    config = value_at(F.col("doc"), "$.config", "variant")
    chosen = parsed.select("path", F.when(is_object(config), config).otherwise(F.col("doc")).alias("doc"))
    doc = F.col("doc")
    git = "$.bundle.git."
    # Where each field sits in a metadata document.
    columns = {
        "bundle_name": _first(doc, "$.bundle.name"),
        "target": _first(doc, "$.bundle.target"),
        "git_origin": _first(doc, git + "origin_url", git + "OriginURL"),
        "git_branch": _first(doc, git + "branch", git + "Branch"),
        "git_commit": _first(doc, git + "commit", git + "Commit"),
        "workspace_root": _first(doc, "$.workspace.root_path"),
        "workspace_file_path": _first(doc, "$.workspace.file_path"),
    }
    return chosen.select("path", *[columns[field].alias(field) for field in METADATA_FIELDS])


def _read_evolved(spark: SparkSession, path: str, known: T.StructType) -> DataFrame:
    """A table whose parts were written over time: the known columns, then any more that some part has.

    Parts are merged by name. A part without a column gives nulls for it.
    """
    schema = evolved_schema(spark, path, known)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def evolved_schema(spark: SparkSession, path: str, known: T.StructType) -> T.StructType:
    """The known columns with their types, and the further columns of the table's parts."""
    merged = spark.read.option("mergeSchema", "true").parquet(path).schema
    return T.StructType([*known.fields, *[f for f in merged.fields if f.name not in known.names]])


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The inventory table with the columns of all its parts; older ones may lack some."""
    return _read_evolved(spark, path, INVENTORY)


def read_removal_log(spark: SparkSession, path: str) -> DataFrame:
    """The removal log with the columns of all its parts; older ones may lack some."""
    return _read_evolved(spark, path, REMOVAL_LOG)
