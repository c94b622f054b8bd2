"""Whole runs over many workspaces at once: inventory, attach, detach, patch, create.

Each function takes tables, plans the run and returns its tables. These are
lazy, but caps, destination lookups, id lists and bundle discovery run small
jobs at call time. Files and tables are written only where a path is given. A
run has one time, taken when it is called.
"""

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfleet import sinks
from jobfleet.functions.filters import url_status
from jobfleet.operators import bundles as ops
from jobfleet.operators import destinations as dest
from jobfleet.operators import reports
from jobfleet.operators.enrich import enrich_bundles
from jobfleet.operators.walk import matched_jobs
from jobfleet.plans import attach as attaching
from jobfleet.plans import detach as detaching
from jobfleet.plans.inventory import inventory_rows
from jobfleet.schemas import DEFAULT_EVENTS, HOST
from jobfleet.sources.bundles import (
    discover_files,
    document_errors,
    job_nodes,
    read_documents,
    require_roots,
)
from jobfleet.sources.job_ids import load_job_ids, merge_job_ids
from jobfleet.sources.snapshots import whole_destinations
from jobfleet.staging import stage


@dataclass
class Inventory:
    rows: DataFrame
    summary: DataFrame
    top_creators: DataFrame
    top_bundles: DataFrame


@dataclass
class Run:
    """``misses`` has a by-id run's lookups that found nothing, ``unread`` the workspaces left out."""

    plan: DataFrame
    stats: DataFrame
    misses: DataFrame | None = field(default=None, kw_only=True)
    unread: DataFrame | None = field(default=None, kw_only=True)

    @property
    def failures(self) -> DataFrame:
        """``(workspace_host, error)`` of the workspaces that failed, each by itself."""
        return reports.failures(self.stats, self.unread)

    @property
    def failed(self) -> bool:
        """Whether any workspace had errors."""
        return reports.run_failed(self.stats, self.unread)


@dataclass
class PatchRun(Run):
    errors: DataFrame

    @property
    def failed(self) -> bool:
        """Whether a bundle was left out because one of its files cannot be read."""
        return not self.errors.isEmpty()


@dataclass
class DetachRun(Run):
    bundle_report: DataFrame | None
    removals: DataFrame | None


def inventory(
    jobs: DataFrame,
    *,
    tag: str | None = None,
    owner: Sequence[str] | None = None,
    name_filter: str | None = None,
    scan_limit: int | None = None,
    metadata: DataFrame | None = None,
    top_n: int = 10,
    scanned_at: Column | None = None,
    output: str = "",
    table: str = "",
    workspaces: DataFrame | None = None,
    failures: DataFrame | None = None,
    session_view: bool = False,
) -> Inventory:
    """Inventory of the matching jobs; give ``metadata`` to enrich bundle jobs.

    ``output`` is a CSV path, ``table`` the path of the inventory table, of
    which the scanned workspaces are replaced. ``workspaces`` are summed up even
    where nothing matched. ``session_view`` offers the rows as a view, unless
    ``failures`` lists workspaces that could not be scanned.
    """
    matched = matched_jobs(
        jobs, tag=tag, owners=owner, name_filter=name_filter, scan_limit=scan_limit
    )
    when = _now() if scanned_at is None else scanned_at
    rows = inventory_rows(matched, when, metadata)
    if table:
        sinks.overwrite_inventory(rows, table)
    sinks.write_inventory_csv(rows, output)
    if session_view:
        sinks.create_session_view(rows, failures)
    return Inventory(
        rows,
        _filled(reports.inventory_summary(matched), workspaces),
        reports.top_creators(matched, top_n),
        reports.top_bundles(enrich_bundles(matched, metadata), top_n),
    )


def resolve(
    jobs: DataFrame, destinations: DataFrame, name: str, workspaces: DataFrame
) -> tuple[DataFrame, Column]:
    """Jobs with their workspace's id for a destination name, and that id's column.

    ``destinations`` are listed destinations or the pages of the listings. Pages have to be whole: a
    destination may stand on one that is missing. Fails before anything is planned when a listing breaks
    off or a workspace lacks the destination.
    """
    if "results" in destinations.columns:
        destinations = whole_destinations(destinations)
    resolved = dest.resolve_destination(destinations, name)
    dest.require_destination(workspaces, resolved, name)
    return dest.with_destination(jobs, resolved), F.col("webhook_id")


def _explicit_ids(
    spark: SparkSession, job_id: Sequence[int], job_ids_from: str | None
) -> DataFrame | None:
    if not job_id and not job_ids_from:
        return None
    from_file = load_job_ids(spark, job_ids_from) if job_ids_from else None
    return merge_job_ids(spark, job_id, from_file)


def _readable(hosts: Sequence[str], unread: DataFrame | None) -> list[str]:
    """The named workspaces without those that could not be read, in which nothing is looked up."""
    if unread is None:
        return list(hosts)
    named = {row[HOST] for row in unread.filter(F.col(HOST).isin(list(hosts))).select(HOST).collect()}  # of the caller's list
    return [h for h in hosts if h not in named]


def _now() -> Column:
    return F.lit(datetime.now(timezone.utc))


def _filled(stats: DataFrame, workspaces: DataFrame | None) -> DataFrame:
    """Counters of the named workspaces too where no row was met."""
    return stats if workspaces is None else reports.every_workspace(stats, workspaces)


def attach(
    jobs: DataFrame,
    webhook_id: str | Column,
    *,
    events: str | Sequence[str] = DEFAULT_EVENTS,
    job_id: Sequence[int] = (),
    job_ids_from: str | None = None,
    hosts: Sequence[str] = (),
    tag: str | None = None,
    owner: Sequence[str] | None = None,
    name_filter: str | None = None,
    scan_limit: int | None = None,
    limit: int | None = None,
    results: DataFrame | None = None,
    workspaces: DataFrame | None = None,
    unread: DataFrame | None = None,
) -> Run:
    """Attach a destination to explicit jobs of ``hosts``, or else to all matching jobs.

    ``results`` says which updates went through; without it the run is dry.
    ``workspaces`` names those that get counters even where nothing matched,
    ``unread`` those that could not be read (``jobs_from_pages``): they fail, all others are planned.
    """
    scope = {"tag": tag, "owners": owner}
    ids = _explicit_ids(jobs.sparkSession, job_id, job_ids_from)
    if ids is not None:
        run = attaching.attach_lookup(
            jobs, ids, _readable(hosts, unread), webhook_id, events=events, limit=limit, results=results, **scope
        )
        plan, misses = run.found, run.misses()
        stats = reports.with_misses(reports.attach_run_stats(plan), run.miss_counts())
    else:
        misses = None
        plan = attaching.attach_walk(
            jobs,
            webhook_id,
            events=events,
            name_filter=name_filter,
            scan_limit=scan_limit,
            limit=limit,
            results=results,
            **scope,
        )
        stats = reports.attach_run_stats(plan)
    return Run(plan, _filled(stats, workspaces), misses=misses, unread=unread)


def detach(
    jobs: DataFrame,
    webhook_id: str | Column | None = None,
    *,
    job_id: Sequence[int] = (),
    job_ids_from: str | None = None,
    hosts: Sequence[str] = (),
    tag: str | None = None,
    owner: Sequence[str] | None = None,
    bundle_jobs: str = "skip",
    name_filter: str | None = None,
    scan_limit: int | None = None,
    limit: int | None = None,
    results: DataFrame | None = None,
    metadata: DataFrame | None = None,
    deleted_at: Column | None = None,
    bundle_report: str = "",
    removal_log: str = "",
    workspaces: DataFrame | None = None,
    unread: DataFrame | None = None,
) -> DetachRun:
    """Detach a destination; explicit jobs without an id lose every webhook.

    ``bundle_report`` is the CSV path of the bundle jobs a walk met and
    ``removal_log`` the path of the log that carried-out removals are added to.
    """
    scope = {"tag": tag, "owners": owner}
    ids = _explicit_ids(jobs.sparkSession, job_id, job_ids_from)
    if ids is not None:
        run = detaching.detach_lookup(jobs, ids, _readable(hosts, unread), webhook_id, results=results, **scope)
        plan, misses, report = run.found, run.misses(), None
        stats = reports.with_misses(reports.detach_run_stats(plan), run.miss_counts())
    else:
        plan = detaching.detach_walk(
            jobs,
            webhook_id,
            bundle_jobs=bundle_jobs,
            name_filter=name_filter,
            scan_limit=scan_limit,
            limit=limit,
            results=results,
            **scope,
        )
        misses, stats = None, reports.detach_run_stats(plan)
        report = detaching.bundle_report(plan, metadata)
        sinks.write_bundle_report_csv(report, bundle_report)
    removals = None
    if results is not None:
        when = _now() if deleted_at is None else deleted_at
        removals = detaching.removal_records(plan, metadata, when)
        if removal_log:
            sinks.append_removal_log(removals, removal_log)
    return DetachRun(plan, _filled(stats, workspaces), report, removals, misses=misses, unread=unread)


def create_destination(
    workspaces: DataFrame, destinations: DataFrame, *, name: str, url: str, apply: bool = False
) -> DataFrame:
    """Which workspaces have the destination and which would get it."""
    status = workspaces.sparkSession.range(1).select(url_status(F.lit(url))).first()[0]
    if status == "invalid":
        raise ValueError(f"{url!r} is not a web address to send notifications to")
    resolved = dest.resolve_destination(destinations, name)
    plan = dest.create_destination_plan(workspaces, resolved, name=name, url=url, apply=apply)
    return plan.withColumn("unencrypted", F.lit(status == "insecure"))


def patch(
    files: DataFrame,
    webhook_id: str,
    *,
    root_file: str,
    events: str | Sequence[str] = DEFAULT_EVENTS,
    job: Sequence[str] = (),
    tag: str | None = None,
    owner: Sequence[str] | None = None,
) -> PatchRun:
    """Patch plan of all bundles whose files are given; statistics are per bundle.

    A bundle without a root file is an error of the run. A file that cannot be
    read fails its own bundle only: that bundle has no plan, and ``errors``
    names the file and what is wrong with it.
    """
    require_roots(files, root_file)
    read = stage(read_documents(discover_files(files, root_file)), "bundle-documents")
    errors = document_errors(read)
    whole = read.join(stage(errors.select("bundle").distinct(), "broken-bundles"), "bundle", "left_anti")
    nodes = job_nodes(whole.filter("doc IS NOT NULL"))
    plan = ops.bundle_patch_plan(
        nodes, webhook_id, events=events, names=job, tag=tag, owners=owner
    )
    return PatchRun(plan, ops.bundle_patch_stats(plan, whole.select("bundle").distinct()), errors)


def workspaces_of(jobs: DataFrame) -> DataFrame:
    return jobs.select(HOST).distinct()
