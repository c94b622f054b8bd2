"""Attach a notification destination to jobs."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfleet.functions.notifications import WebhookId, attached_to_all, with_webhook
from jobfleet.operators.caps import mutation_cap
from jobfleet.operators.walk import walk
from jobfleet.plans import outcomes as o
from jobfleet.plans.by_id import Lookup, check_by_id, start
from jobfleet.plans.updates import settle
from jobfleet.schemas import DEFAULT_EVENTS, parse_events


def _outcome(webhook_id: WebhookId, events: Sequence[str]):
    # Bundle-managed jobs are always left alone: a deployment would undo the edit.
    return (
        F.when(F.col("is_bundle"), o.BUNDLE_SKIPPED)
        .when(attached_to_all(F.col("notifications"), webhook_id, events), o.ALREADY_ATTACHED)
        .otherwise(o.WOULD_UPDATE)
    )


def _payload(webhook_id: WebhookId, events: Sequence[str]):
    new = with_webhook(F.col("notifications"), webhook_id, events)
    return F.when(F.col("outcome").isin(*o.SENT), new)


def _require(webhook_id: WebhookId) -> None:
    if webhook_id is None or (isinstance(webhook_id, str) and not webhook_id):
        raise ValueError("there is no destination id to attach")


def attach_walk(
    jobs: DataFrame,
    webhook_id: WebhookId,
    *,
    events: str | Sequence[str] = DEFAULT_EVENTS,
    tag: str | None = None,
    owners: Sequence[str] | None = None,
    name_filter: str | None = None,
    scan_limit: int | None = None,
    limit: int | None = None,
    results: DataFrame | None = None,
    keep_all: bool = False,
) -> DataFrame:
    """Plan over whole workspaces: the walk's columns plus ``outcome`` and
    ``new_notifications`` (the update payload).

    ``webhook_id`` is one id, or a column where each workspace has its own.
    Without ``results`` the plan is a dry run.
    """
    _require(webhook_id)
    events = parse_events(events)
    plan = walk(
        jobs,
        tag=tag,
        owners=owners,
        name_filter=name_filter,
        scan_limit=scan_limit,
        keep_all=keep_all,
    )
    plan = plan.withColumn("outcome", F.when(F.col("matched"), _outcome(webhook_id, events)))
    plan = mutation_cap(
        settle(plan, results),
        limit,
        checked=F.col("matched") & ~F.col("is_bundle"),
        changed=F.col("outcome").isin(*o.CHANGED),
        keep_all=keep_all,
    )
    return plan.withColumn("new_notifications", _payload(webhook_id, events))


def attach_lookup(
    jobs: DataFrame,
    ids: DataFrame,
    hosts: Sequence[str],
    webhook_id: WebhookId,
    *,
    events: str | Sequence[str] = DEFAULT_EVENTS,
    limit: int | None = None,
    results: DataFrame | None = None,
    tag: str | None = None,
    owners: Sequence[str] | None = None,
) -> Lookup:
    """Plan for an explicit id list (``job_id``, ``pos``), looked up in every workspace.

    ``found`` has the plan of the jobs that there are; the others are counted.
    """
    _require(webhook_id)
    check_by_id(hosts, tag, owners)
    events = parse_events(events)
    asked = start(jobs, ids, hosts, _outcome(webhook_id, events))
    run = asked.with_rows(settle(asked.found, results)).cut(limit, F.col("outcome").isin(*o.CHANGED))
    return run.with_rows(run.found.withColumn("new_notifications", _payload(webhook_id, events)))


def attach_by_id(jobs: DataFrame, ids: DataFrame, hosts: Sequence[str], webhook_id: WebhookId, **options) -> DataFrame:
    """``attach_lookup`` as one table, with a row for each lookup that finds nothing."""
    return attach_lookup(jobs, ids, hosts, webhook_id, **options).listed(o.LOOKUP_FAILED)
