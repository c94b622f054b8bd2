"""Notification destinations looked up by display name, per workspace."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfleet.schemas import HOST
from jobfleet.staging import stage


class MissingDestinations(ValueError):
    """Some workspaces have no destination of the given name."""


def resolve_destination(destinations: DataFrame, name: str) -> DataFrame:
    """The first destination with that exact display name in each workspace."""
    first = F.min_by(F.struct("id", "destination_type"), "ordinal")
    return (
        destinations.filter(F.col("display_name") == name)
        .groupBy(HOST)
        .agg(first.alias("first"))
        .select(HOST, F.col("first.id").alias("webhook_id"), "first.destination_type")
    )


def missing_destinations(workspaces: DataFrame, resolved: DataFrame) -> DataFrame:
    return workspaces.join(resolved, HOST, "left_anti").select(HOST)


def require_destination(workspaces: DataFrame, resolved: DataFrame, name: str) -> None:
    """Abort a run before planning when any workspace lacks the destination."""
    missing = missing_destinations(workspaces, resolved)
    count = missing.count()
    if count:
        sample = [row[HOST] for row in missing.orderBy(HOST).limit(20).collect()]
        raise MissingDestinations(
            f"{count} workspace(s) lack a destination called {name!r}, such as {sample}"
        )


def with_destination(jobs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Jobs with the ``webhook_id`` of their own workspace.

    A workspace without the destination has no id to plan with, and none of its
    jobs are planned; ``require_destination`` makes that an error beforehand.
    The lookup is staged, so that it is broadcast if it turns out small.
    """
    return jobs.join(stage(resolved.select(HOST, "webhook_id"), "webhook-ids"), HOST)


def create_destination_plan(
    workspaces: DataFrame, resolved: DataFrame, *, name: str, url: str, apply: bool = False
) -> DataFrame:
    """Per workspace: report the destination that exists, else create one."""
    missing = F.col("webhook_id").isNull()
    action = F.when(missing, "create" if apply else "would_create").otherwise("exists")
    known_type = F.coalesce(F.nullif("destination_type", F.lit("")), F.lit("?"))
    return workspaces.join(resolved, HOST, "left").select(
        HOST,
        action.alias("action"),
        F.col("webhook_id"),
        F.lit(name).alias("display_name"),
        F.when(~missing, known_type).alias("destination_type"),
        F.when(missing, F.lit(url)).alias("url"),
    )
