"""Every registered query: name -> function of a session and an input folder."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobfleet import runs, sinks
from jobfleet.functions import filters as f
from jobfleet.functions import notifications as n
from jobfleet.operators import bundles as b
from jobfleet.operators import destinations as dest
from jobfleet.operators import reports as r
from jobfleet.operators.enrich import enrich_bundles
from jobfleet.operators.walk import matched_jobs
from jobfleet.plans import attach as at
from jobfleet.plans import detach as de
from jobfleet.plans import inventory as inv
from jobfleet.plans.updates import apply_changes, changes, next_snapshot
from jobfleet.queries import tables as t
from jobfleet.schemas import DEFAULT_EVENTS, EVENT_FIELDS, HOST, SESSION_VIEW
from jobfleet.sources import bundles as bs
from jobfleet.sources import job_ids as ids
from jobfleet.sources import on_demand as od
from jobfleet.sources import pages as pg
from jobfleet.sources import snapshots as s
from jobfleet.staging import spread, stage, staging_path

Query = Callable[[SparkSession, str], DataFrame]

TARGET = "wh-3"
OWNERS = ["user1@example.com", "user7@example.com", "user42@example.com"]
EXPLICIT_IDS = [5, 37, 999999999]
SCANNED_AT = "2024-01-01 00:00:00"
LATER = "2024-01-02 00:00:00"
NEWEST = "2024-01-03 00:00:00"
DESTINATION = "hook-0"
PARTLY_MISSING = "hook-1"
BUNDLE_OWNERS = ["user7", "user12", "user24", "user33"]
BUNDLE_NAMES = ["red widget", "small ring", "old bolt"]
BUNDLE_TAG = "type=ECONOMY"

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def at_time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def flat(block: Column) -> list[Column]:
    return [n.flat_ids(block[event]).alias(event) for event in EVENT_FIELDS]


def flat_snapshot(snapshot: DataFrame, *more: str) -> DataFrame:
    return snapshot.select(
        HOST, "job_id", *more, f.or_blank(F.col("settings.name")).alias("name"),
        *flat(F.col("settings.webhook_notifications")),
    )


def flat_plan(plan: DataFrame, *more: str) -> DataFrame:
    planned = plan.filter(F.col("outcome").isNotNull())
    return planned.select(HOST, "job_id", "outcome", *more, *flat(F.col("new_notifications")))


def flat_detach(plan: DataFrame) -> DataFrame:
    planned = plan.filter(F.col("outcome").isNotNull())
    return planned.select(
        HOST,
        "job_id",
        "outcome",
        "bundle_warning",
        F.coalesce("removed_count", F.lit(0)).cast("long").alias("removed_count"),
        F.concat_ws(",", "webhook_ids_removed").alias("ids_removed"),
        F.concat_ws(",", "events_affected").alias("events_affected"),
        *flat(F.col("new_notifications")),
    )


def flat_times(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


def flat_log(log: DataFrame) -> DataFrame:
    return flat_times(log, "deleted_at").withColumns(
        {
            "webhook_ids_removed": F.concat_ws(",", "webhook_ids_removed"),
            "events_affected": F.concat_ws(",", "events_affected"),
        }
    )


# Inventory ---------------------------------------------------------------


@query
def jobs_from_pages(spark, sf):
    """Listing pages written as JSON, put in order, stored as a snapshot and read back."""
    exported, stored = staging_path(spark, "job-pages"), staging_path(spark, "jobs-read")
    t.write_job_pages(t.job_pages(spark, sf), exported)
    listed, _ = pg.jobs_from_pages(pg.read_job_pages(spark, exported), t.workspaces(spark, sf))
    spread(listed, HOST).write.partitionBy(HOST).parquet(stored)
    jobs = s.read_jobs(spark, stored)
    return flat_snapshot(jobs, "scan_ordinal")


@query
def workspace_read_failures(spark, sf):
    """One workspace has a record that is cut off, one lacks a page: both fail, the others are planned."""
    path = staging_path(spark, "job-pages")
    pages = t.job_pages(spark, sf).filter((F.col(HOST) != "ws-4") | (F.col("page") != 1))
    cut = F.when((F.col(HOST) == "ws-2") & (F.col("page") == 1), 40)
    t.write_job_pages(pages.withColumn("cut", cut), path)
    jobs, unread = pg.jobs_from_pages(pg.read_job_pages(spark, path), t.workspaces(spark, sf))
    run = runs.attach(jobs, TARGET, workspaces=t.workspaces(spark, sf), unread=unread)
    error = F.coalesce(F.substring_index("error", ", such as", 1), F.lit("")).alias("error")
    return run.stats.join(run.failures, HOST, "left").select(HOST, error, "scanned", "bundle_skipped", "would_update")


@query
def classify_deployment(spark, sf):
    path = F.when(f.is_bundle(), F.col("settings.deployment.metadata_file_path"))
    return t.jobs(spark, sf).select(
        HOST, "job_id", f.deployment_kind().alias("deployment_kind"),
        f.or_blank(path).alias("metadata_file_path"),
    )


@query
def inventory_rows(spark, sf):
    rows = inv.inventory_rows(matched_jobs(t.jobs(spark, sf)), at_time(SCANNED_AT))
    return flat_times(rows, "scanned_at")


def _inventory(spark, sf, **scope) -> DataFrame:
    matched = matched_jobs(t.jobs(spark, sf), **scope)
    return inv.inventory_rows(matched, at_time(SCANNED_AT), t.metadata(spark, sf))


@query
def inventory_rows_enriched(spark, sf):
    return flat_times(_inventory(spark, sf), "scanned_at")


@query
def bundle_metadata(spark, sf):
    return s.bundle_metadata(t.metadata_documents(spark, sf)).select(
        "path", *[f.or_blank(F.col(c)).alias(c) for c in s.METADATA_FIELDS]
    )


@query
def enrich_from_files(spark, sf):
    """Metadata written as one file per bundle, read back and joined by workspace path."""
    folder = staging_path(spark, "metadata-export")
    t.write_files(t.metadata_documents(spark, sf), folder, "/Workspace/")
    documents = s.read_metadata_documents(spark, folder, "/Workspace")
    enriched = enrich_bundles(matched_jobs(t.jobs(spark, sf)), s.bundle_metadata(documents))
    return enriched.filter("is_bundle").select(
        HOST, "job_id", *[f.or_blank(F.col(c)).alias(c) for c in s.METADATA_FIELDS]
    )


@query
def enrich_on_demand(spark, sf):
    """Of an export with ten files per bundle only those that jobs name are read; some are missing."""
    folder = staging_path(spark, "metadata-export")
    documents = t.metadata_documents(spark, sf)
    others = documents.select(F.explode(F.sequence(F.lit(1), F.lit(9))).alias("copy"), "path").select(
        F.concat(F.col("path"), F.lit("."), "copy").alias("path"), F.lit("not asked for").alias("content")
    )
    t.write_files(documents.unionByName(others), folder, "/Workspace/")
    jobs = matched_jobs(t.jobs(spark, sf))
    fetched = od.fetch_documents(od.metadata_paths(jobs), folder, "/Workspace")
    enriched = enrich_bundles(jobs, s.bundle_metadata(fetched)).filter("is_bundle")
    missing = fetched.filter(F.col("error").isNotNull()).select(F.col("path").alias("metadata_path"), F.lit(True).alias("lost"))
    return enriched.join(missing, "metadata_path", "left").select(
        HOST, "job_id", F.coalesce("lost", F.lit(False)).alias("lost"),
        *[f.or_blank(F.col(c)).alias(c) for c in s.METADATA_FIELDS],
    )


@query
def bundle_enrich(spark, sf):
    enriched = enrich_bundles(matched_jobs(t.jobs(spark, sf)), t.metadata(spark, sf))
    return enriched.filter("is_bundle").select(
        HOST, "job_id", *[f.or_blank(F.col(c)).alias(c) for c in ("bundle_name", "target", "git_commit")]
    )


def _ids(rows: DataFrame) -> DataFrame:
    return rows.select(HOST, "job_id")


@query
def filter_owner(spark, sf):
    return _ids(matched_jobs(t.jobs(spark, sf), owners=OWNERS))


@query
def filter_owner_unset(spark, sf):
    return _ids(matched_jobs(t.jobs(spark, sf), owners=[""]))


@query
def filter_tag_value(spark, sf):
    return _ids(matched_jobs(t.jobs(spark, sf), tag="team=BUILDING"))


@query
def filter_tag_present(spark, sf):
    return _ids(matched_jobs(t.jobs(spark, sf), tag="tier"))


@query
def filter_name(spark, sf):
    return _ids(matched_jobs(t.jobs(spark, sf), name_filter="high-1"))


@query
def filter_combined(spark, sf):
    return _ids(
        matched_jobs(
            t.jobs(spark, sf), owners=OWNERS, tag="team=BUILDING", name_filter="u", scan_limit=1500
        )
    )


@query
def scan_cap(spark, sf):
    return _ids(matched_jobs(t.jobs(spark, sf), scan_limit=50))


@query
def scan_cap_large(spark, sf):
    return _ids(matched_jobs(t.jobs(spark, sf), scan_limit=2001))


@query
def inventory_summary(spark, sf):
    summary = r.inventory_summary(matched_jobs(t.jobs(spark, sf)))
    return summary.withColumns(
        {c: F.round(c, 4) for c in ("bundle_pct", "direct_pct")}
    )


@query
def top_creators(spark, sf):
    return r.top_creators(matched_jobs(t.jobs(spark, sf)), 10)


@query
def top_creators_large(spark, sf):
    """The first 150 of each workspace, where it has hundreds of creators."""
    creator = F.concat(F.lit("user"), F.col("job_id") * F.col("job_id") % 1009)
    jobs = t.jobs(spark, sf).withColumn("creator_user_name", creator)
    return r.top_creators(matched_jobs(jobs), 150)


@query
def top_bundles(spark, sf):
    enriched = enrich_bundles(matched_jobs(t.jobs(spark, sf)), t.metadata(spark, sf))
    return r.top_bundles(enriched, 10)


@query
def jobs_per_workspace(spark, sf):
    return r.jobs_per_workspace(_inventory(spark, sf))


@query
def bundles_by_target(spark, sf):
    return r.bundles_by_target(_inventory(spark, sf))


@query
def direct_job_ids(spark, sf):
    return r.job_ids_of_kind(_inventory(spark, sf), "DIRECT")


@query
def cohort_rollback(spark, sf):
    jobs = t.jobs(spark, sf)
    members = r.cohort(jobs, r.job_ids_of_kind(_inventory(spark, sf), "BUNDLE"))
    return flat_detach(de.detach_walk(members, TARGET, bundle_jobs="include"))


@query
def inventory_overwrite(spark, sf):
    path = staging_path(spark, "inventory")
    sinks.overwrite_inventory(_inventory(spark, sf), path)
    again = _inventory(spark, sf, tag="team=BUILDING").filter(F.col(HOST).isin("ws-0", "ws-1"))
    sinks.overwrite_inventory(again.withColumn("scanned_at", at_time(LATER)), path)
    return flat_times(s.read_inventory(spark, path), "scanned_at")


@query
def inventory_csv(spark, sf):
    path = staging_path(spark, "inventory-csv")
    sinks.write_inventory_csv(_inventory(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in sinks.INVENTORY_CSV_COLUMNS)
    written = spark.read.schema(schema).options(**sinks.CSV_FORMAT).csv(path)
    return written.select(
        F.col("job_id").cast("long"),
        *[f.or_blank(F.col(c)).alias(c) for c in sinks.INVENTORY_CSV_COLUMNS if c != "job_id"],
    )


@query
def session_view(spark, sf):
    sinks.create_session_view(_inventory(spark, sf))
    return r.jobs_per_workspace(spark.table(SESSION_VIEW))


# Attach ------------------------------------------------------------------


@query
def attached_all(spark, sf):
    block = F.col("settings.webhook_notifications")
    return t.jobs(spark, sf).select(
        HOST, "job_id", n.attached_to_all(block, TARGET, DEFAULT_EVENTS).alias("attached")
    )


@query
def attached_any(spark, sf):
    block = F.col("settings.webhook_notifications")
    return t.jobs(spark, sf).select(HOST, "job_id", n.attached_to_any(block, TARGET).alias("attached"))


@query
def attach_plan(spark, sf):
    return flat_plan(at.attach_walk(t.jobs(spark, sf), TARGET))


@query
def attach_all_events(spark, sf):
    return flat_plan(at.attach_walk(t.jobs(spark, sf), TARGET, events=",".join(EVENT_FIELDS)))


@query
def attach_scoped(spark, sf):
    scope = {"tag": "team=BUILDING", "name_filter": "-1", "scan_limit": 1200, "limit": 30}
    return flat_plan(at.attach_walk(t.jobs(spark, sf), TARGET, **scope))


@query
def attach_capped(spark, sf):
    return flat_plan(at.attach_walk(t.jobs(spark, sf), TARGET, limit=40))


@query
def attach_capped_large(spark, sf):
    return flat_plan(at.attach_walk(t.jobs(spark, sf), TARGET, limit=1200))


@query
def attach_capped_sparse(spark, sf):
    """Ordinals two million apart: the listing of a workspace with very wide gaps."""
    jobs = t.jobs(spark, sf).withColumn("scan_ordinal", F.col("scan_ordinal") * (1 << 21))
    return flat_plan(at.attach_walk(jobs, TARGET, limit=1200))


@query
def attach_applied_capped(spark, sf):
    results = t.update_results(spark, sf)
    return flat_plan(at.attach_walk(t.jobs(spark, sf), TARGET, limit=100, results=results))


@query
def attach_run_stats(spark, sf):
    results = t.update_results(spark, sf)
    return r.attach_run_stats(at.attach_walk(t.jobs(spark, sf), TARGET, results=results))


@query
def attach_run_stats_capped(spark, sf):
    scope = {"tag": "tier", "scan_limit": 1400, "limit": 60}
    return r.attach_run_stats(at.attach_walk(t.jobs(spark, sf), TARGET, **scope))


@query
def attach_by_name(spark, sf):
    destinations = s.scan_destinations(t.destination_pages(spark, sf))
    resolved = dest.resolve_destination(destinations, DESTINATION)
    jobs = dest.with_destination(t.jobs(spark, sf), resolved)
    return flat_plan(at.attach_walk(jobs, F.col("webhook_id")))


@query
def next_snapshot_attach(spark, sf):
    plan = at.attach_walk(t.jobs(spark, sf), TARGET, name_filter="low", keep_all=True)
    return flat_snapshot(next_snapshot(plan))


# Explicit ids ------------------------------------------------------------


def _id_list(spark, sf) -> DataFrame:
    listed = ids.load_job_ids(spark, t.job_id_file(spark, sf))
    return ids.merge_job_ids(spark, EXPLICIT_IDS, listed)


@query
def load_job_ids(spark, sf):
    return ids.load_job_ids(spark, t.job_id_file(spark, sf))


@query
def job_ids_from_csv(spark, sf):
    """An inventory CSV as an id file; names hold line breaks inside quotes."""
    path = staging_path(spark, "ids-csv")
    rows = _inventory(spark, sf).withColumn("name", F.concat(F.lit("a\n"), "job_id", F.lit("\nb")))
    rows.select("job_id", "name").write.options(**sinks.CSV_FORMAT).csv(path)
    return ids.load_job_ids(spark, path, multi_line=True).select("job_id")


@query
def merge_job_ids(spark, sf):
    return _id_list(spark, sf)


@query
def attach_by_id(spark, sf):
    plan = at.attach_by_id(t.jobs(spark, sf), _id_list(spark, sf), t.hosts(spark, sf), TARGET)
    return flat_plan(plan, "pos")


@query
def attach_by_id_capped(spark, sf):
    plan = at.attach_by_id(t.jobs(spark, sf), _id_list(spark, sf), t.hosts(spark, sf), TARGET, limit=75)
    return r.attach_run_stats(plan)


@query
def by_id_run_stats(spark, sf):
    """Counters of an applied run over an id list; what a workspace lacks is counted, not listed."""
    run = runs.attach(
        t.jobs(spark, sf), TARGET, job_id=EXPLICIT_IDS, job_ids_from=t.job_id_file(spark, sf),
        hosts=t.hosts(spark, sf), limit=75, results=t.update_results(spark, sf),
    )
    return run.stats


@query
def detach_by_id(spark, sf):
    return flat_detach(de.detach_by_id(t.jobs(spark, sf), _id_list(spark, sf), t.hosts(spark, sf), TARGET))


@query
def detach_all(spark, sf):
    return flat_detach(de.detach_by_id(t.jobs(spark, sf), _id_list(spark, sf), t.hosts(spark, sf)))


@query
def next_snapshot_by_id(spark, sf):
    jobs = t.jobs(spark, sf)
    plan = de.detach_by_id(jobs, _id_list(spark, sf), t.hosts(spark, sf), TARGET)
    return flat_snapshot(apply_changes(jobs, changes(plan)))


# Detach ------------------------------------------------------------------


@query
def detach_one(spark, sf):
    return flat_detach(de.detach_walk(t.jobs(spark, sf), TARGET, bundle_jobs="include"))


def _policy(spark, sf, policy: str) -> DataFrame:
    plan = de.detach_walk(t.jobs(spark, sf), TARGET, bundle_jobs=policy)
    return plan.select(HOST, "job_id", "outcome", "bundle_warning")


@query
def detach_skip(spark, sf):
    return _policy(spark, sf, "skip")


@query
def detach_include(spark, sf):
    return _policy(spark, sf, "include")


@query
def detach_only(spark, sf):
    return _policy(spark, sf, "only")


@query
def detach_capped(spark, sf):
    return flat_detach(de.detach_walk(t.jobs(spark, sf), TARGET, bundle_jobs="include", limit=25))


@query
def detach_run_stats(spark, sf):
    plan = de.detach_walk(t.jobs(spark, sf), TARGET, results=t.update_results(spark, sf))
    return r.detach_run_stats(plan)


@query
def workspace_failures(spark, sf):
    plan = de.detach_walk(t.jobs(spark, sf), TARGET, bundle_jobs="only", results=t.update_results(spark, sf))
    return r.workspace_failures(r.detach_run_stats(plan))


@query
def next_snapshot_detach(spark, sf):
    plan = de.detach_walk(
        t.jobs(spark, sf), TARGET, bundle_jobs="include",
        results=t.update_results(spark, sf), keep_all=True,
    )
    return flat_snapshot(next_snapshot(plan))


@query
def next_snapshot_retried(spark, sf):
    plan = de.detach_walk(
        t.jobs(spark, sf), TARGET, bundle_jobs="include",
        results=t.retried_results(spark, sf), keep_all=True,
    )
    return flat_snapshot(next_snapshot(plan))


@query
def removal_log_retried(spark, sf):
    plan = de.detach_walk(
        t.jobs(spark, sf), TARGET, bundle_jobs="include", results=t.retried_results(spark, sf)
    )
    return flat_log(de.removal_records(plan, t.metadata(spark, sf), at_time(SCANNED_AT)))


@query
def run_stats_all_workspaces(spark, sf):
    """A run over every job of every workspace; a workspace without jobs counts zero."""
    return runs.attach(t.jobs(spark, sf), TARGET, workspaces=t.workspaces(spark, sf)).stats


@query
def bundle_report(spark, sf):
    plan = de.detach_walk(t.jobs(spark, sf), TARGET, tag="tier")
    return de.bundle_report(plan, t.metadata(spark, sf))


@query
def bundle_report_csv(spark, sf):
    path = staging_path(spark, "bundle-report-csv")
    report = de.bundle_report(
        de.detach_walk(t.jobs(spark, sf), TARGET, bundle_jobs="only"), t.metadata(spark, sf)
    )
    sinks.write_bundle_report_csv(report, path)
    schema = ", ".join(f"{c} string" for c in sinks.BUNDLE_REPORT_COLUMNS)
    written = spark.read.schema(schema).options(**sinks.CSV_FORMAT).csv(path)
    return written.select(
        F.col("job_id").cast("long"),
        *[f.or_blank(F.col(c)).alias(c) for c in sinks.BUNDLE_REPORT_COLUMNS if c != "job_id"],
    )


def _removals(spark, sf, policy: str, at: str) -> DataFrame:
    plan = de.detach_walk(
        t.jobs(spark, sf), TARGET, bundle_jobs=policy, results=t.update_results(spark, sf)
    )
    return de.removal_records(plan, t.metadata(spark, sf), at_time(at))


@query
def removal_log(spark, sf):
    return flat_log(_removals(spark, sf, "include", SCANNED_AT))


@query
def audit_recent(spark, sf):
    path = staging_path(spark, "removal-log")
    sinks.append_removal_log(_removals(spark, sf, "skip", SCANNED_AT), path)
    sinks.append_removal_log(_removals(spark, sf, "only", LATER), path)
    return flat_log(r.audit_recent(s.read_removal_log(spark, path)))


@query
def removal_log_evolved(spark, sf):
    """A log of three ages: an older part lacks two columns, a newer one has one more."""
    path = staging_path(spark, "removal-log")
    sinks.append_removal_log(_removals(spark, sf, "skip", SCANNED_AT).drop("git_branch", "is_bundle"), path)
    sinks.append_removal_log(_removals(spark, sf, "only", LATER), path)
    newer = _removals(spark, sf, "only", NEWEST).withColumn("ticket", F.concat(F.lit("T-"), F.col("job_id")))
    sinks.append_removal_log(newer, path)
    log = flat_log(s.read_removal_log(spark, path))
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in ("git_branch", "is_bundle", "ticket")}
    return log.withColumns(blank)


# Destinations, errors, hosts ---------------------------------------------


def _destinations(spark, sf) -> DataFrame:
    return s.scan_destinations(t.destination_pages(spark, sf))


@query
def destinations_from_pages(spark, sf):
    """Listing pages written as JSON, read back, checked to be whole, and resolved."""
    path = staging_path(spark, "destination-pages")
    t.destination_pages(spark, sf).write.json(path)
    return dest.resolve_destination(s.whole_destinations(s.read_destination_pages(spark, path)), DESTINATION)


@query
def cut_listings(spark, sf):
    """Workspaces of odd number have a last page that names a further one."""
    more = F.when(F.col(HOST).rlike("[13579]$"), F.lit("more"))
    pages = t.destination_pages(spark, sf)
    return s.cut_listings(pages.withColumn("next_page_token", F.coalesce("next_page_token", more)))


@query
def scan_destinations(spark, sf):
    return _destinations(spark, sf).drop("ordinal")


@query
def resolve_destination(spark, sf):
    return dest.resolve_destination(_destinations(spark, sf), DESTINATION)


@query
def missing_destinations(spark, sf):
    resolved = dest.resolve_destination(_destinations(spark, sf), PARTLY_MISSING)
    return dest.missing_destinations(t.workspaces(spark, sf), resolved)


@query
def create_destination_plan(spark, sf):
    resolved = dest.resolve_destination(_destinations(spark, sf), PARTLY_MISSING)
    plan = dest.create_destination_plan(
        t.workspaces(spark, sf), resolved, name=PARTLY_MISSING, url="https://hooks.example.com/abc"
    )
    return plan.select(*[f.or_blank(F.col(c)).alias(c) for c in plan.columns])


@query
def validate_url(spark, sf):
    pages = t.read(spark, sf, "pages")
    return pages.select("page_id", "url", f.url_status(F.col("url")).alias("status"))


@query
def classify_transient(spark, sf):
    kind = F.col("event_type")
    code = F.when(kind == "error", "503")
    message = (
        F.when(kind == "error", "backend down")
        .when(kind == "signup", "Rate limit exceeded")
        .when(kind == "purchase", "HTTP 429")
        .when(kind == "view", "PERMISSION_DENIED")
        .otherwise("failed to iterate page")
    )
    attempts = t.read(spark, sf, "events").select(
        F.col("event_id").alias("attempt_id"),
        F.col("user_id").alias("job_id"),
        code.alias("error_code"),
        message.alias("message"),
    )
    transient = f.is_transient(F.col("message"), F.col("error_code"))
    return attempts.select("attempt_id", "job_id", transient.alias("transient"))


@query
def normalise_hosts(spark, sf):
    site = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    raw = F.concat(F.lit(" "), site, F.lit("/ ,,"), site, F.lit(":443// , "))
    pages = t.read(spark, sf, "pages").select("page_id", raw.alias("raw"))
    return pages.select(
        "page_id", F.posexplode(f.host_list(F.col("raw"))).alias("place", HOST)
    ).withColumn("place", F.col("place").cast("long"))


# Bundles -----------------------------------------------------------------


@query
def bundle_files(spark, sf):
    files = bs.discover_files(t.bundle_files(spark, sf), t.ROOT_FILE)
    return files.select("bundle", "path", F.col("pattern_pos").cast("long").alias("pattern_pos"))


@query
def bundle_files_from_folder(spark, sf):
    """The same files in a folder per bundle, read back from there."""
    folder = staging_path(spark, "bundles")
    path = F.concat(F.translate("bundle", "#", "-"), F.lit("/"), F.col("path"))
    t.write_files(t.bundle_files(spark, sf).withColumn("path", path), folder, "")
    files = bs.discover_files(bs.read_bundle_files(spark, folder), t.ROOT_FILE)
    return files.select("bundle", "path", F.col("pattern_pos").cast("long").alias("pattern_pos"))


@query
def missing_roots(spark, sf):
    files = t.bundle_files(spark, sf)
    return bs.missing_roots(files.filter(~F.col("bundle").endswith("1") | (F.col("path") != t.ROOT_FILE)), t.ROOT_FILE)


@query
def bundle_errors(spark, sf):
    """Each hundredth part's file is broken off: its bundle fails, the others are patched."""
    number = F.regexp_extract("path", "job_([0-9]+)", 1).try_cast("long")
    broken = F.coalesce(number % 100 == 3, F.lit(False))
    files = t.bundle_files(spark, sf).withColumn(
        "content", F.when(broken, F.lit("resources: {jobs: [")).otherwise(F.col("content"))
    )
    run = runs.patch(files, TARGET, root_file=t.ROOT_FILE)
    kept = run.stats.select("bundle", F.lit("").alias("path"), "jobs_seen")
    return run.errors.select("bundle", "path", F.lit(-1).cast("long").alias("jobs_seen")).unionByName(kept)


@query
def bundle_docs(spark, sf):
    docs = bs.parse_documents(t.bundle_files(spark, sf))
    has = lambda path: F.try_variant_get("doc", path, "variant").isNotNull()
    return docs.select(
        "bundle",
        "path",
        has("$.include").alias("has_include"),
        has("$.resources").alias("has_resources"),
        has("$.targets").alias("has_targets"),
    )


def _flat_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "bundle", "path", "label", f.or_blank(F.col("target")).alias("target"), "job_key",
        *flat(F.col("notifications")),
    )


@query
def bundle_job_nodes(spark, sf):
    return _flat_nodes(t.derive_bundle_nodes(spark, sf))


@query
def bundle_job_filter(spark, sf):
    nodes = t.bundle_nodes(spark, sf)
    return nodes.select(
        "label",
        b.node_named(BUNDLE_NAMES).alias("named"),
        b.node_tagged(BUNDLE_TAG).alias("tagged"),
        b.node_owned_by(BUNDLE_OWNERS).alias("owned"),
        b.bundle_job_filter(BUNDLE_NAMES, BUNDLE_TAG, BUNDLE_OWNERS).alias("all_three"),
    )


def _patch_plan(spark, sf, **scope) -> DataFrame:
    return b.bundle_patch_plan(t.bundle_nodes(spark, sf), TARGET, **scope)


@query
def bundle_patch_plan(spark, sf):
    plan = _patch_plan(spark, sf)
    return plan.select(
        "label",
        "matched",
        "changed",
        F.concat_ws(",", "var_skipped").alias("var_skipped"),
        F.concat_ws(",", "dup_events").alias("dup_events"),
        *flat(F.col("new_notifications")),
    )


@query
def bundle_patch_stats(spark, sf):
    return b.bundle_patch_stats(_patch_plan(spark, sf, tag=BUNDLE_TAG))


@query
def override_dup_events(spark, sf):
    plan = _patch_plan(spark, sf, tag=BUNDLE_TAG)
    warned = plan.filter(F.size("dup_events") > 0)
    return warned.select("bundle", "label", F.concat_ws(",", "dup_events").alias("dup_events"))


@query
def effective_notifications(spark, sf):
    patched = b.patched_bundle_jobs(_patch_plan(spark, sf))
    rows = b.effective_notifications(patched, b.override_nodes(t.bundle_nodes(spark, sf)))
    return rows.select(
        "bundle",
        "job_key",
        f.or_blank(F.col("target")).alias("target"),
        *[F.concat_ws(",", F.col("notifications")[e]["id"]).alias(e) for e in EVENT_FIELDS],
        *[F.concat_ws(",", F.col("duplicate_ids")[e]).alias(f"dup_{e}") for e in DEFAULT_EVENTS],
    )


@query
def effective_all_targets(spark, sf):
    """All targets of a bundle: a second one, in a file of its own, with a job only it has."""
    files = t.bundle_files(spark, sf)
    dev = F.lit(
        '{"targets": {"dev": {"resources": {"jobs": {"dev_only": {"webhook_notifications":'
        ' {"on_failure": [{"id": "wh-3"}]}}}}}}}'
    )
    extra = files.filter(F.col("path") == t.ROOT_FILE).select(
        "bundle", F.lit("resources/dev.yml").alias("path"), dev.alias("content")
    )
    docs = stage(bs.parse_documents(bs.discover_files(files.unionByName(extra), t.ROOT_FILE)), "bundle-documents")
    nodes = stage(bs.job_nodes(docs), "bundle-nodes")
    patched = b.patched_bundle_jobs(b.bundle_patch_plan(nodes, TARGET))
    rows = b.effective_notifications(patched, b.override_nodes(nodes), bs.bundle_targets(docs))
    return rows.select(
        "bundle",
        "job_key",
        "target",
        *[F.concat_ws(",", F.col("notifications")[e]["id"]).alias(e) for e in EVENT_FIELDS],
        *[F.concat_ws(",", F.col("duplicate_ids")[e]).alias(f"dup_{e}") for e in DEFAULT_EVENTS],
    )


@query
def patched_bundle_jobs(spark, sf):
    rows = b.patched_bundle_jobs(_patch_plan(spark, sf, owners=BUNDLE_OWNERS))
    return rows.select("bundle", "label", "changed", *flat(F.col("notifications")))
