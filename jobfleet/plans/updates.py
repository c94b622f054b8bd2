"""Results of planned updates, and the snapshot that follows from them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfleet.functions.filters import or_false
from jobfleet.plans.outcomes import CHANGED, ERRORED, UPDATED, WOULD_UPDATE
from jobfleet.schemas import EVENT_FIELDS, HOST, JOB_KEY, JOBS
from jobfleet.staging import stage

NOT_SENT = 1024


def settle(plan: DataFrame, results: DataFrame | None) -> DataFrame:
    """Turn planned updates into updated or errored rows.

    A planned row without a successful result is errored; of several results for a job one success is
    enough. The verdicts are staged, so that few of them are broadcast, and joined in the plan's one pass over the fleet.
    Rows that were not sent have one of ``NOT_SENT`` workspace names that no result has: where the join is by
    shuffle they neither find a verdict nor meet in one task.
    """
    if results is None:
        return plan
    verdicts = results.groupBy(*JOB_KEY).agg(F.bool_or("ok").alias("ok"))
    verdicts = stage(verdicts.select(F.col(HOST).alias("sent_host"), F.col("job_id").alias("sent_id"), "ok"), "verdicts")
    planned = or_false(F.col("outcome") == WOULD_UPDATE)
    nowhere = F.concat(F.lit("\0"), F.pmod(F.hash(*JOB_KEY), F.lit(NOT_SENT)))
    keyed = plan.withColumns(
        {"sent_host": F.when(planned, F.col(HOST)).otherwise(nowhere), "sent_id": F.when(planned, F.col("job_id"))}
    )
    settled = F.when(or_false(F.col("ok")), UPDATED).otherwise(ERRORED)
    return (
        keyed.join(verdicts, ["sent_host", "sent_id"], "left")
        .withColumn("outcome", F.when(planned, settled).otherwise(F.col("outcome")))
        .drop("sent_host", "sent_id", "ok")
    )


def _next_settings(changed, notifications):
    settings = F.col("settings")
    cleared = F.struct(
        *[F.when(F.size(notifications[e]) > 0, notifications[e]).alias(e) for e in EVENT_FIELDS]
    )
    replaced = F.struct(
        settings["name"].alias("name"),
        settings["tags"].alias("tags"),
        settings["deployment"].alias("deployment"),
        cleared.alias("webhook_notifications"),
    )
    return F.when(changed, replaced).otherwise(settings).alias("settings")


def next_snapshot(plan: DataFrame) -> DataFrame:
    """The snapshot after a walk planned with ``keep_all``; no join is needed."""
    changed = or_false(F.col("outcome").isin(*CHANGED))
    columns = [F.col(name) for name in JOBS.names if name != "settings"]
    return plan.select(*columns, _next_settings(changed, F.col("new_notifications")))


def changes(plan: DataFrame) -> DataFrame:
    """The update payloads of a plan: one row per job that gets a new block."""
    changed = F.col("outcome").isin(*CHANGED)
    return plan.filter(changed).select(*JOB_KEY, "new_notifications")


def apply_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """The snapshot after a stored or by-id plan: changed rows joined onto all jobs."""
    marked = changes.dropDuplicates(JOB_KEY).withColumn("is_changed", F.lit(True))
    joined = jobs.join(marked, JOB_KEY, "left")
    columns = [F.col(name) for name in JOBS.names if name != "settings"]
    return joined.select(
        *columns, _next_settings(or_false(F.col("is_changed")), F.col("new_notifications"))
    )
