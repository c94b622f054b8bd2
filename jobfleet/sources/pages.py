"""Job listings exported page by page: their order, and the workspaces that cannot be read.

A page names the one after it by a token. A workspace's listing is whole when its pages are one chain from the page that was
asked for without a token to one that names no other. Everything is said per
workspace: a record that cannot be parsed, a file that ends early or a page that is missing fails its
own workspace, which is then a row of ``listing_faults``, and no other one.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobfleet.functions.filters import or_blank
from jobfleet.operators.order import running_total
from jobfleet.schemas import HOST, JOB_PAGES, JOBS, LISTING_FAULTS
from jobfleet.staging import stage

UNREADABLE = "unreadable"
PAGE = [HOST, "page_token"]


def read_job_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all workspaces from JSON lines below ``workspace_host=...`` folders.

    Nothing that a file holds ends the read. A record that is no page keeps its text in ``unreadable``. The
    rest of a damaged file is left out, which its workspace's chain of pages then shows.
    """
    schema = T.StructType([*JOB_PAGES.fields, T.StructField(UNREADABLE, T.StringType())])
    pages = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", UNREADABLE)
        .option("ignoreCorruptFiles", "true")
        .json(path)
    )
    return pages.select("*", F.col("_metadata.file_path").alias("file"))


def _outlines(pages: DataFrame) -> DataFrame:
    """(workspace_host, page_token, next_page_token, size, broken, file) of all pages, read once: blank for no token."""
    tokens = [or_blank(F.col(c)).alias(c) for c in ("page_token", "next_page_token")]
    size = F.coalesce(F.array_size("jobs"), F.lit(0)).cast("long").alias("size")
    return stage(pages.select(HOST, *tokens, size, F.col(UNREADABLE).isNotNull().alias("broken"), "file"), "job-pages")


def followed(links: DataFrame) -> DataFrame:
    """Links with ``to_end``: how many pages follow up to the last one; null where the chain does not get there.

    Every round each page takes over what the page it points to knows, and points to where that one does,
    so a chain of n pages takes log2(n) rounds. Pages that have arrived no longer take part, and
    a chain that turns back on itself points in circles until the rounds for all pages are done.
    """
    known = stage(
        links.select(*PAGE, F.col("next_page_token").alias("to"), F.lit(0).cast("long").alias("steps"), (F.col("next_page_token") == "").alias("done")),
        "page-links",
    )
    most = known.groupBy(HOST).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length()):
        target = known.select(HOST, F.col("page_token").alias("to"), F.col("to").alias("to_to"), F.col("steps").alias("more"), F.col("done").alias("arrived"))
        moved = known.filter("not done").join(target, [HOST, "to"])
        moved = moved.select(*PAGE, F.col("to_to").alias("to"), (F.col("steps") + F.col("more") + 1).alias("steps"), F.col("arrived").alias("done"))
        # a page whose next one is missing has no row from here on
        known = stage(known.filter("done").unionByName(moved), "page-links")
        if known.filter("not done").isEmpty():
            break
    return links.join(known.filter("done").select(*PAGE, F.col("steps").alias("to_end")), PAGE, "left")


def _faults(hosts: DataFrame, order: Column, error: Column) -> DataFrame:
    return hosts.select(HOST, F.struct(order.alias("order"), error.alias("error")).alias("fault"))


def _examined(pages: DataFrame, workspaces: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links of whole listings with their chains, and the faults of the others."""
    outlines = _outlines(pages)
    links = outlines.filter("not broken").drop("broken", "file")
    unreadable = outlines.filter("broken").groupBy(HOST).agg(F.count(F.lit(1)).alias("n"), F.min("file").alias("file"))
    faults = _faults(unreadable, F.lit(1), F.concat(F.col("n"), F.lit(" record(s) cannot be read, such as in "), F.substring_index("file", "/", -1)))
    twice = links.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy(HOST).agg(F.min("page_token").alias("page_token"))
    faults = faults.union(_faults(twice, F.lit(2), F.concat(F.lit("a page is there twice: "), F.col("page_token"))))
    twice = stage(twice.select(HOST), "repeated-pages")
    chained = stage(followed(links.join(twice, HOST, "left_anti")), "page-chains")
    first = F.max(F.when(F.col("page_token") == "", F.coalesce(F.col("to_end") + 1, F.lit(0))))
    lengths = chained.groupBy(HOST).agg(F.count(F.lit(1)).alias("n"), first.alias("chain"))
    broken = (
        F.when(F.col("chain").isNull(), F.lit("the first page is missing"))
        .when(F.col("chain") == 0, F.lit("the listing breaks off before its last page"))
        .when(F.col("chain") < F.col("n"), F.concat(F.col("n") - F.col("chain"), F.lit(" page(s) belong to no listing")))
    )
    faults = faults.union(_faults(lengths.filter(broken.isNotNull()), F.lit(3), broken))
    if workspaces is not None:
        faults = faults.union(_faults(workspaces.select(HOST).join(outlines.select(HOST).distinct(), HOST, "left_anti"), F.lit(4), F.lit("nothing was exported")))
    faults = faults.groupBy(HOST).agg(F.min("fault").alias("fault")).select(HOST, "fault.error")
    faults = stage(faults.select(*LISTING_FAULTS.names), "listing-faults")
    return chained.join(faults, HOST, "left_anti"), faults


def listing_faults(pages: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """``(workspace_host, error)`` of the workspaces whose listing cannot be read whole.

    With ``workspaces`` those without any page are among them.
    """
    return _examined(pages, workspaces)[1]


def jobs_from_pages(pages: DataFrame, workspaces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Job snapshots of the workspaces that can be read, and the faults of the others.

    ``scan_ordinal`` counts a workspace's jobs in the order of its chain. The offsets of pages come from a
    running total over page sizes; the jobs themselves are not sorted.
    """
    chained, faults = _examined(pages, workspaces)
    last = chained.groupBy(HOST).agg(F.max("to_end").alias("last"))
    ordered = chained.join(stage(last, "last-pages"), HOST).withColumn("page", F.col("last") - F.col("to_end"))
    placed = running_total(ordered, F.col("size"), "page", [HOST], "upto")
    offsets = stage(placed.select(*PAGE, (F.col("upto") - F.col("size")).alias("offset")), "page-offsets")
    whole = pages.filter(F.col(UNREADABLE).isNull()).withColumn("page_token", or_blank(F.col("page_token")))
    listed = whole.join(offsets, PAGE).select(HOST, "offset", F.posexplode("jobs").alias("place", "job"))
    jobs = listed.select(HOST, (F.col("offset") + F.col("place")).alias("scan_ordinal"), "job.*")
    return jobs.select(*JOBS.names), faults
