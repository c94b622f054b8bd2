"""Bundle job nodes: filters, patch plan, overrides and deploy-time lists."""

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfleet.functions.filters import or_false, parse_tag
from jobfleet.functions.notifications import append_missing, holds, no_webhooks
from jobfleet.functions.variants import text_at, text_of, value_at
from jobfleet.schemas import DEFAULT_EVENTS, EVENT_FIELDS, parse_events

# Permission levels that make an owner, keys that name a principal.
OWNER_LEVELS = ("IS_OWNER", "CAN_MANAGE")
PRINCIPAL_KEYS = ("user_name", "service_principal_name", "group_name")
VARIABLE_PREFIX = "${"


def node_named(names: Sequence[str] | None) -> Column:
    if not names:
        return F.lit(True)
    return or_false(text_at(F.col("node"), "$.name").isin(list(names)))


def node_tagged(tag: str | None) -> Column:
    """Tag test without type conversion: a number never equals the text of it."""
    parsed = parse_tag(tag)
    if parsed is None:
        return F.lit(True)
    key, value = parsed
    tags = value_at(F.col("node"), "$.tags", "map<string,variant>")
    if value is None:
        return or_false(F.map_contains_key(tags, key))
    return or_false(text_of(F.try_element_at(tags, F.lit(key))) == value)


def node_owned_by(owners: Sequence[str] | None) -> Column:
    """Any owning permission entry that names one of the owners."""
    if not owners:
        return F.lit(True)

    def owns(permission: Column) -> Column:
        named = [text_at(permission, f"$.{key}").isin(list(owners)) for key in PRINCIPAL_KEYS]
        return or_false(text_at(permission, "$.level").isin(*OWNER_LEVELS)) & reduce(
            or_, [or_false(name) for name in named]
        )

    permissions = value_at(F.col("node"), "$.permissions", "array<variant>")
    return or_false(F.exists(permissions, owns))


def bundle_job_filter(
    names: Sequence[str] | None = None, tag: str | None = None, owners: Sequence[str] | None = None
) -> Column:
    return node_named(names) & node_tagged(tag) & node_owned_by(owners)


def has_variable_ref(webhooks: Column) -> Column:
    return or_false(F.exists(webhooks, lambda w: or_false(w["id"].startswith(VARIABLE_PREFIX))))


def _events_where(events: Sequence[str], test) -> Column:
    hits = [F.when(test(F.col("notifications")[event]), F.lit(event)) for event in events]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def override_dup_events(webhook_id: str, events: Sequence[str]) -> Column:
    """Events on which a target override already lists the id."""
    return _events_where(events, lambda webhooks: holds(webhooks, webhook_id))


def bundle_patch_plan(
    nodes: DataFrame,
    webhook_id: str,
    *,
    events: str | Sequence[str] = DEFAULT_EVENTS,
    names: Sequence[str] | None = None,
    tag: str | None = None,
    owners: Sequence[str] | None = None,
) -> DataFrame:
    """What a patch would do to each node.

    Base nodes get ``matched``, ``changed``, ``var_skipped`` (events left alone
    because a variable is listed) and ``new_notifications``. Overrides are
    never changed; they get ``dup_events`` whatever the filters say.
    """
    if not webhook_id:
        raise ValueError("webhook_id is required")
    events = parse_events(events)
    is_base = F.col("target").isNull()
    matched = is_base & bundle_job_filter(names, tag, owners)
    none = F.array().cast("array<string>")

    def appends(webhooks: Column) -> Column:
        return ~has_variable_ref(webhooks) & ~holds(webhooks, webhook_id)

    new_lists = []
    for event in EVENT_FIELDS:
        webhooks = F.col("notifications")[event]
        if event in events:
            webhooks = F.when(has_variable_ref(webhooks), webhooks).otherwise(
                append_missing(webhooks, webhook_id)
            )
        new_lists.append(webhooks.alias(event))

    appended = _events_where(events, appends)
    return (
        nodes.withColumn("matched", matched)
        .withColumns(
            {
                "changed": F.col("matched") & (F.size(appended) > 0),
                "var_skipped": F.when(F.col("matched"), _events_where(events, has_variable_ref)).otherwise(none),
                "dup_events": F.when(~is_base, override_dup_events(webhook_id, events)).otherwise(none),
            }
        )
        .withColumn(
            "new_notifications",
            F.when(F.col("changed"), F.struct(*new_lists)).otherwise(F.col("notifications")),
        )
    )


def bundle_patch_stats(plan: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """Patch counters per bundle. Files are counted first, then bundles, so that
    the distinct file count needs no separate pass. ``bundles`` names those that
    get a row even without job nodes."""
    per_file = plan.groupBy("bundle", "path").agg(
        F.count("*").alias("jobs_seen"),
        F.count_if("matched").alias("jobs_matched"),
        F.count_if("changed").alias("jobs_patched"),
        F.count_if(F.col("target").isNotNull()).alias("overrides_skipped"),
        F.sum(F.size("var_skipped")).alias("var_skipped_events"),
    )
    totals = ["jobs_seen", "jobs_matched", "jobs_patched", "overrides_skipped", "var_skipped_events"]
    counters = per_file.groupBy("bundle").agg(
        F.count_if(F.col("jobs_patched") > 0).alias("files_changed"),
        *[F.sum(name).alias(name) for name in totals],
    )
    if bundles is None:
        return counters
    return bundles.select("bundle").join(counters, "bundle", "left").na.fill(0)


def patched_bundle_jobs(plan: DataFrame) -> DataFrame:
    """Base job nodes as they stand after the patch."""
    return plan.filter(F.col("target").isNull()).select(
        "bundle", "path", "label", "job_key", "node", "changed",
        F.col("new_notifications").alias("notifications"),
    )


def override_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("target").isNotNull())


def effective_notifications(
    base_jobs: DataFrame, overrides: DataFrame, targets: DataFrame | None = None
) -> DataFrame:
    """What targets deploy: base lists followed by the override's lists.

    ``base_jobs`` are base nodes, patched or not. ``duplicate_ids`` names, per
    event, the ids listed twice; a deployment rejects those. With ``targets``,
    the targets of each bundle, every target has all base jobs of its bundle,
    overridden or not, and the jobs that only it has; a bundle without targets
    keeps its base jobs under a null target. Without, only overrides are shown,
    and a base job without any has a null target.
    """
    base = base_jobs.select("bundle", "job_key", F.col("notifications").alias("base"))
    override = overrides.select(
        "bundle", "job_key", "target", F.col("notifications").alias("override")
    )
    merged, repeated = [], []
    for event in EVENT_FIELDS:
        both = F.concat(
            F.coalesce(F.col("base")[event], no_webhooks()),
            F.coalesce(F.col("override")[event], no_webhooks()),
        )
        merged.append(both.alias(event))
        repeated.append(_repeated_ids(both["id"]).alias(event))
    if targets is None:
        joined = base.join(override, ["bundle", "job_key"], "left")
    else:
        placed = base.join(targets.select("bundle", "target").distinct(), "bundle", "left")
        keys = ("bundle", "target", "job_key")
        override = override.withColumnsRenamed({k: f"own_{k}" for k in keys})
        same = [F.col(k) == F.col(f"own_{k}") for k in keys]
        joined = placed.join(override, same, "full").select(
            *[F.coalesce(k, f"own_{k}").alias(k) for k in keys], "base", "override"
        )
    return joined.select(
        "bundle",
        "job_key",
        "target",
        F.struct(*merged).alias("notifications"),
        F.struct(*repeated).alias("duplicate_ids"),
    )


def _repeated_ids(ids: Column) -> Column:
    return F.filter(
        F.array_distinct(F.array_compact(ids)),
        lambda wanted: F.size(F.filter(ids, lambda other: other == wanted)) > 1,
    )
