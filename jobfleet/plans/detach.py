"""Detach a notification destination from jobs."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfleet.functions.filters import or_blank
from jobfleet.functions.notifications import (
    WebhookId,
    attached_to_any,
    events_affected,
    ids_removed,
    removed_count,
    without_webhook,
)
from jobfleet.operators.caps import mutation_cap
from jobfleet.operators.enrich import enrich_bundles, metadata_columns
from jobfleet.operators.walk import walk
from jobfleet.plans import outcomes as o
from jobfleet.plans.by_id import Lookup, check_by_id, start
from jobfleet.plans.updates import settle
from jobfleet.schemas import BUNDLE_POLICIES, HOST, REMOVAL_LOG

REMOVALS = ("removed_count", "webhook_ids_removed", "events_affected")


def _removals(plan: DataFrame, webhook_id: WebhookId) -> DataFrame:
    """What updates take away. Told before results are joined, so that a log needs no lists after that."""
    before = F.col("notifications")
    after = without_webhook(before, webhook_id)
    facts = (removed_count(before, after), ids_removed(before, after, webhook_id), events_affected(before, after))
    sent = F.col("outcome").isin(*o.SENT)
    return plan.withColumns({name: F.when(sent, fact) for name, fact in zip(REMOVALS, facts, strict=True)})


def _details(plan: DataFrame, webhook_id: WebhookId) -> DataFrame:
    """The payload of updates in the run; rows that a cap left out have no removals either."""
    sent = F.col("outcome").isin(*o.SENT)
    payload = {"new_notifications": F.when(sent, without_webhook(F.col("notifications"), webhook_id))}
    return plan.withColumns({**payload, **{name: F.when(sent, F.col(name)) for name in REMOVALS}})


def detach_walk(
    jobs: DataFrame,
    webhook_id: WebhookId,
    *,
    bundle_jobs: str = "skip",
    tag: str | None = None,
    owners: Sequence[str] | None = None,
    name_filter: str | None = None,
    scan_limit: int | None = None,
    limit: int | None = None,
    results: DataFrame | None = None,
    keep_all: bool = False,
) -> DataFrame:
    """Plan over whole workspaces; columns as in an attach plan plus ``bundle_warning``,
    ``removed_count``, ``webhook_ids_removed`` and ``events_affected``."""
    if webhook_id is None or (isinstance(webhook_id, str) and not webhook_id):
        raise ValueError("lists are emptied for listed job ids only; a walk takes one destination id away")
    if bundle_jobs not in BUNDLE_POLICIES:
        raise ValueError(f"{bundle_jobs!r} is no policy for bundle jobs; choose from {', '.join(BUNDLE_POLICIES)}")
    bundle = F.col("is_bundle")
    plan = walk(
        jobs,
        tag=tag,
        owners=owners,
        name_filter=name_filter,
        scan_limit=scan_limit,
        keep_all=keep_all,
    )
    outcome = (
        F.when(bundle & F.lit(bundle_jobs == "skip"), o.BUNDLE_SKIPPED)
        .when(~bundle & F.lit(bundle_jobs == "only"), o.DIRECT_EXCLUDED)
        .when(attached_to_any(F.col("notifications"), webhook_id), o.WOULD_UPDATE)
        .otherwise(o.NOTHING_TO_REMOVE)
    )
    plan = plan.withColumn("outcome", F.when(F.col("matched"), outcome))
    plan = mutation_cap(
        settle(_removals(plan, webhook_id), results),
        limit,
        checked=F.col("outcome").isin(*o.SENT),
        changed=F.col("outcome").isin(*o.CHANGED),
        keep_all=keep_all,
    )
    warned = F.col("matched") & bundle & F.lit(bundle_jobs == "include")
    return _details(plan.withColumn("bundle_warning", warned), webhook_id)


def detach_lookup(
    jobs: DataFrame,
    ids: DataFrame,
    hosts: Sequence[str],
    webhook_id: WebhookId = None,
    *,
    results: DataFrame | None = None,
    tag: str | None = None,
    owners: Sequence[str] | None = None,
) -> Lookup:
    """Plan for an explicit id list; no id given clears every list of those jobs.

    Bundle-managed jobs are included, with ``bundle_warning`` set. ``found`` has the plan of
    the jobs that there are; the others are counted.
    """
    check_by_id(hosts, tag, owners)
    before = F.col("notifications")
    removes = removed_count(before, without_webhook(before, webhook_id)) > 0
    outcome = F.when(before.isNotNull() & removes, o.WOULD_UPDATE).otherwise(o.NOTHING_TO_REMOVE)
    asked = start(jobs, ids, hosts, outcome)
    plan = settle(_removals(asked.found, webhook_id), results)
    return asked.with_rows(_details(plan.withColumn("bundle_warning", F.col("is_bundle")), webhook_id))


def detach_by_id(
    jobs: DataFrame, ids: DataFrame, hosts: Sequence[str], webhook_id: WebhookId = None, **options
) -> DataFrame:
    """``detach_lookup`` as one table, with a row for each lookup that finds nothing."""
    listed = detach_lookup(jobs, ids, hosts, webhook_id, **options).listed(o.LOOKUP_FAILED)
    return listed.withColumn("bundle_warning", F.col("is_bundle"))


def bundle_report(plan: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """Every matched bundle-managed job a detach walk met, skipped ones included."""
    met = plan.filter(F.col("matched") & F.col("is_bundle"))
    return enrich_bundles(met, metadata).select(
        HOST,
        "job_id",
        F.col("job_name").alias("name"),
        or_blank(F.col("creator_user_name")).alias("creator"),
        *metadata_columns(),
        or_blank(F.col("metadata_path")).alias("metadata_file_path"),
    )


def removal_records(plan: DataFrame, metadata: DataFrame | None, deleted_at: Column) -> DataFrame:
    """Log rows of the removals that were carried out; dry runs give none."""
    done = plan.filter(F.col("outcome") == o.UPDATED)
    return (
        enrich_bundles(done, metadata)
        .select(
            HOST,
            deleted_at.cast("timestamp").alias("deleted_at"),
            "job_id",
            F.col("job_name").alias("name"),
            or_blank(F.col("creator_user_name")).alias("creator"),
            "is_bundle",
            "webhook_ids_removed",
            "events_affected",
            *metadata_columns(),
            or_blank(F.col("metadata_path")).alias("metadata_file_path"),
        )
        .select(*REMOVAL_LOG.names)
    )
