"""Counts, breakdowns and run statistics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobfleet.functions.filters import creator_label
from jobfleet.operators.caps import RANKED_ROWS
from jobfleet.operators.order import numbered
from jobfleet.plans import outcomes as o
from jobfleet.schemas import BUNDLE, HOST, ORDINAL
from jobfleet.staging import stage


def inventory_summary(matched: DataFrame) -> DataFrame:
    """Totals and shares of bundle-managed and direct jobs per workspace."""
    counts = matched.groupBy(HOST).agg(
        F.count("*").alias("total"),
        F.count_if("is_bundle").alias("bundle"),
        F.count_if(~F.col("is_bundle")).alias("direct"),
    )
    return counts.withColumns(
        {"bundle_pct": _percent("bundle"), "direct_pct": _percent("direct")}
    )


def _percent(part: str) -> Column:
    return F.when(F.col("total") > 0, F.col(part) / F.col("total") * 100).otherwise(F.lit(0.0))


def _top(rows: DataFrame, label: Column, name: str, n: int) -> DataFrame:
    """The ``n`` most frequent labels of each workspace; ties go to the label met first in the listing.

    Up to ``RANKED_ROWS`` every task sends its first n rows per workspace. For more, the counts themselves are
    added up first: a workspace has few different ones, and they say where the cut lies. The labels above
    it are then put in one order over all tasks, so that no workspace is ranked in one.
    """
    counts = rows.groupBy(HOST, label.alias(name)).agg(
        F.count("*").alias("jobs"), F.min(ORDINAL).alias("first_met")
    )
    if n <= RANKED_ROWS:
        order = Window.partitionBy(HOST).orderBy(F.desc("jobs"), "first_met")
        ranked = counts.withColumn("position", F.row_number().over(order))
    else:
        ranked = _ranked(stage(counts, "label-counts"), n)
    return ranked.filter(F.col("position") <= n).select(HOST, name, "jobs", F.col("position").cast("long"))


def _ranked(counts: DataFrame, n: int) -> DataFrame:
    above = Window.partitionBy(HOST).orderBy(F.desc("jobs")).rowsBetween(Window.unboundedPreceding, -1)
    levels = counts.groupBy(HOST, "jobs").agg(F.count("*").alias("labels"))
    before = F.coalesce(F.sum("labels").over(above), F.lit(0))
    wanted = stage(levels.withColumn("before", before).filter(F.col("before") < n).select(HOST, "jobs"), "top-levels")
    placed = numbered(counts.join(wanted, [HOST, "jobs"], "left_semi"), [F.col(HOST), F.desc("jobs"), F.col("first_met")])
    first = stage(placed.groupBy(HOST).agg(F.min("number").alias("first")), "workspace-firsts")
    return placed.join(first, HOST).withColumn("position", F.col("number") - F.col("first") + 1)


def top_creators(matched: DataFrame, n: int = 10) -> DataFrame:
    return _top(matched, creator_label(), "creator", n)


def top_bundles(enriched: DataFrame, n: int = 10) -> DataFrame:
    named = enriched.filter(F.col("is_bundle") & (F.col("bundle_name") != ""))
    return _top(named, F.col("bundle_name"), "bundle_name", n)


def jobs_per_workspace(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(HOST).agg(F.count("*").alias("jobs"))


def job_ids_of_kind(inventory: DataFrame, kind: str) -> DataFrame:
    """An id list cut from the inventory."""
    return inventory.filter(F.col("deployment_kind") == kind).select("job_id")


def cohort(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """The jobs whose id is on a list."""
    return jobs.join(ids, "job_id", "left_semi")


def bundles_by_target(inventory: DataFrame) -> DataFrame:
    return (
        inventory.filter(F.col("deployment_kind") == BUNDLE)
        .groupBy("bundle_name", "target")
        .agg(F.count("*").alias("jobs"))
        .orderBy(F.desc("jobs"), "bundle_name", "target")
    )


def _outcome_counts(plan: DataFrame, counters: dict[str, Sequence[str]], extra: Sequence[Column] = ()):
    return plan.groupBy(HOST).agg(
        F.count_if("scanned").alias("scanned"),
        F.count_if("matched").alias("matched"),
        *[F.count_if(F.col("outcome").isin(*names)).alias(c) for c, names in counters.items()],
        *extra,
    )


def attach_run_stats(plan: DataFrame) -> DataFrame:
    """Counters of an attach run per workspace."""
    return _outcome_counts(
        plan,
        {
            "already_attached": [o.ALREADY_ATTACHED],
            "bundle_skipped": [o.BUNDLE_SKIPPED],
            "would_update": [o.WOULD_UPDATE],
            "updated": [o.UPDATED],
            "errored": [o.ERRORED, o.LOOKUP_FAILED],
        },
    )


def detach_run_stats(plan: DataFrame) -> DataFrame:
    """Counters of a detach run per workspace."""
    return _outcome_counts(
        plan,
        {
            "nothing_to_remove": [o.NOTHING_TO_REMOVE],
            "bundle_skipped": [o.BUNDLE_SKIPPED],
            "would_update": [o.WOULD_UPDATE],
            "updated": [o.UPDATED],
            "errored": [o.ERRORED, o.LOOKUP_FAILED],
        },
        [F.count_if(F.col("matched") & F.col("is_bundle")).alias("bundle_total")],
    )


def with_misses(stats: DataFrame, missed: DataFrame) -> DataFrame:
    """Counters of found jobs, and ``(workspace_host, missed)`` lookups that found nothing as errors."""
    joined = missed.join(stats, HOST, "left").na.fill(0)
    more = {c: F.col(c) + F.col("missed") for c in ("scanned", "errored")}
    return joined.withColumns(more).select(*stats.columns)


def every_workspace(stats: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Per-workspace counts with zeros for workspaces that had no rows at all."""
    return workspaces.select(HOST).join(stats, HOST, "left").na.fill(0)


def workspace_failures(stats: DataFrame) -> DataFrame:
    """Workspaces whose run had errors."""
    return stats.filter(F.col("errored") > 0).select(HOST, "errored")


def failures(stats: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """``(workspace_host, error)``: workspaces with failed jobs, and those that could not be read."""
    failed = workspace_failures(stats).select(HOST, F.concat(F.col("errored"), F.lit(" job(s) failed")).alias("error"))
    return failed if unread is None else failed.unionByName(unread.select(HOST, "error"))


def run_failed(stats: DataFrame, unread: DataFrame | None = None) -> bool:
    return not failures(stats, unread).isEmpty()


def audit_recent(removal_log: DataFrame) -> DataFrame:
    """The log, newest first. All rows of a run share one time, so the sort needs
    further keys to spread a large run over many tasks."""
    return removal_log.orderBy(F.desc("deleted_at"), HOST, "job_id")
