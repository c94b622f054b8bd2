"""Expressions over a notifications block: one list of ``{id}`` structs per event."""

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobfleet.functions.filters import or_false
from jobfleet.schemas import EVENT_FIELDS, WEBHOOKS

WebhookId = str | Column | None


def id_column(webhook_id: WebhookId) -> Column:
    if isinstance(webhook_id, Column):
        return webhook_id
    return F.lit(webhook_id).cast("string")


def no_webhooks() -> Column:
    return F.array().cast(WEBHOOKS)


def entry(webhook_id: WebhookId) -> Column:
    return F.struct(id_column(webhook_id).alias("id"))


def length(webhooks: Column) -> Column:
    return F.when(webhooks.isNull(), 0).otherwise(F.size(webhooks))


def holds(webhooks: Column, webhook_id: WebhookId) -> Column:
    """Whether the list has the id; false for a null list and for null entries."""
    return or_false(F.array_contains(webhooks["id"], id_column(webhook_id)))


def append_missing(webhooks: Column, webhook_id: WebhookId) -> Column:
    return F.when(holds(webhooks, webhook_id), webhooks).otherwise(
        F.concat(F.coalesce(webhooks, no_webhooks()), F.array(entry(webhook_id)))
    )


def attached_to_all(block: Column, webhook_id: WebhookId, events: Sequence[str]) -> Column:
    """On every target event; a null block is never attached."""
    checks = [holds(block[event], webhook_id) for event in events]
    return reduce(and_, checks, block.isNotNull())


def attached_to_any(block: Column, webhook_id: WebhookId) -> Column:
    return reduce(or_, [holds(block[event], webhook_id) for event in EVENT_FIELDS])


def with_webhook(block: Column, webhook_id: WebhookId, events: Sequence[str]) -> Column:
    """The block with the id appended where missing; empty lists become absent."""
    lists = []
    for event in EVENT_FIELDS:
        webhooks = block[event]
        if event in events:
            lists.append(append_missing(webhooks, webhook_id).alias(event))
        else:
            lists.append(F.when(F.size(webhooks) > 0, webhooks).alias(event))
    return F.struct(*lists)


def without_webhook(block: Column, webhook_id: WebhookId) -> Column:
    """The block without the id. A null id clears every list.

    Lists that were empty stay absent (no change); lists that become empty
    are ``[]`` (clear).
    """
    lists = []
    for event in EVENT_FIELDS:
        webhooks = block[event]
        cleared = F.when(F.size(webhooks) > 0, no_webhooks())
        if webhook_id is None:
            lists.append(cleared.alias(event))
            continue
        wanted = id_column(webhook_id)
        kept = F.when(F.size(webhooks) > 0, F.array_remove(webhooks, entry(wanted)))
        lists.append(F.when(wanted.isNull(), cleared).otherwise(kept).alias(event))
    return F.struct(*lists)


def removed_per_event(before: Column, after: Column) -> list[Column]:
    return [length(before[event]) - length(after[event]) for event in EVENT_FIELDS]


def removed_count(before: Column, after: Column) -> Column:
    return reduce(add, removed_per_event(before, after))


def events_affected(before: Column, after: Column) -> Column:
    names = [
        F.when(removed > 0, F.lit(event))
        for event, removed in zip(EVENT_FIELDS, removed_per_event(before, after))
    ]
    return F.array_compact(F.array(*names))


def ids_removed(before: Column, after: Column, webhook_id: WebhookId) -> Column:
    """Distinct ids taken off, in event order; blank ids are counted but not listed."""
    wanted = id_column(webhook_id)
    ids = [F.coalesce(before[event]["id"], F.array().cast("array<string>")) for event in EVENT_FIELDS]
    listed = F.array_remove(F.array_distinct(F.array_compact(F.concat(*ids))), "")
    one = F.when(removed_count(before, after) > 0, F.array(wanted)).otherwise(
        F.array().cast("array<string>")
    )
    return F.when(wanted.isNull(), listed).otherwise(one)


def flat_ids(webhooks: Column) -> Column:
    """Comma-joined ids for reports; a null list shows as ``<null>``."""
    return F.coalesce(F.when(webhooks.isNotNull(), F.concat_ws(",", webhooks["id"])), F.lit("<null>"))
