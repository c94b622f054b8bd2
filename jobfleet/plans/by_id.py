"""Explicit job ids looked up in every workspace of a run.

A lookup that finds nothing is a number, not a row: each workspace is asked for every id of the run, so what it lacks
is the ids of the run less the jobs found. ``misses`` writes the missing ids out for those who want to see them.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobfleet.operators.caps import STOP, before_stop, stop_ordinals
from jobfleet.operators.order import running_total
from jobfleet.operators.walk import job_facts
from jobfleet.schemas import HOST, SETTINGS
from jobfleet.staging import stage


def check_by_id(hosts: Sequence[str], tag: str | None, owners: Sequence[str] | None) -> None:
    """Listed jobs are looked up where the caller says and are not filtered."""
    if not hosts:
        raise ValueError("say in which workspaces to look the job ids up")
    if tag or owners:
        raise ValueError("job ids leave nothing for a tag or owner filter to choose")


def look_up(jobs: DataFrame, ids: DataFrame, hosts: Sequence[str], outcome: Column) -> DataFrame:
    """The requested jobs that there are, with their ``pos``, flags, facts and ``outcome``.

    The only join with the snapshot: by job id, in which the snapshot is shuffled at most once, and not at
    all when the staged id list is small. The outcome is told from the job alone, before the join: who asks for
    nothing more gets it without a shuffle of the lists.
    """
    told = job_facts(jobs.filter(F.col(HOST).isin(list(hosts)))).withColumn("outcome", outcome)
    found = told.select(*jobs.columns, "is_bundle", "outcome").join(ids.select("job_id", "pos"), "job_id")
    return job_facts(found.withColumns({"scanned": F.lit(True), "matched": F.lit(True)}), known=["is_bundle"])


@dataclass
class Lookup:
    """A by-id run: the rows of the jobs found, and where each workspace's run stops in the id list."""

    found: DataFrame
    ids: DataFrame
    hosts: list[str]
    stops: DataFrame | None = None

    def cut(self, limit: int | None, changed: Column) -> "Lookup":
        """The run up to each workspace's ``limit``-th change.

        The limit is tested after every id, found or not, so a limit below one ends the run with the first id.
        """
        if limit is None:
            return self
        if limit > 0:
            stops = stop_ordinals(self.found.filter(changed), limit, "pos")
        else:
            first = self.ids.agg(F.min("pos").alias(STOP)).select(F.explode(F.array(*map(F.lit, self.hosts))).alias(HOST), STOP)
            stops = stage(first, "stops")
        kept = self.found.join(stops, HOST, "left").filter(before_stop(F.col(STOP), F.col("pos"), inclusive=True))
        return Lookup(kept.drop(STOP), self.ids, self.hosts, stops)

    def with_rows(self, found: DataFrame) -> "Lookup":
        return Lookup(found, self.ids, self.hosts, self.stops)

    def asked(self) -> DataFrame:
        """``(workspace_host, asked)``: how many ids each workspace's run looks up.

        A row per workspace. Where runs stop early, stops and ids are put in one order and counted together.
        """
        hosts = self.ids.sparkSession.createDataFrame([(h,) for h in self.hosts], f"{HOST} string")
        count, last = self.ids.agg(F.count(F.lit(1)), F.max("pos")).first()
        if self.stops is None or not count:
            return hosts.select(HOST, F.lit(count).cast("long").alias("asked"))
        marks = self.ids.select(F.lit(None).cast("string").alias(HOST), "pos", F.lit(1).alias("one"))
        ends = hosts.join(self.stops, HOST, "left")
        ends = ends.select(HOST, F.coalesce(STOP, F.lit(last)).alias("pos"), F.lit(0).alias("one"))
        counted = running_total(marks.unionByName(ends), F.col("one"), "pos", name="asked")
        return counted.filter(F.col(HOST).isNotNull()).select(HOST, "asked")

    def miss_counts(self) -> DataFrame:
        """``(workspace_host, missed)``: ids of the run that a workspace does not have."""
        found = self.found.groupBy(HOST).agg(F.count_distinct("job_id").alias("found"))
        missed = F.col("asked") - F.coalesce("found", F.lit(0))
        return self.asked().join(found, HOST, "left").select(HOST, missed.alias("missed"))

    def misses(self) -> DataFrame:
        """``(workspace_host, job_id, pos)`` of each lookup that found nothing: a row per miss."""
        # by job id, as the jobs were found: an id has its workspaces beside it before it becomes a row for each other one
        having = self.found.groupBy("job_id").agg(F.collect_set(HOST).alias("having"))
        every = F.array(*[F.lit(host) for host in self.hosts]).cast("array<string>")
        others = F.array_except(every, F.coalesce("having", F.array().cast("array<string>")))
        missed = self.ids.join(having, "job_id", "left").select(F.explode(others).alias(HOST), "job_id", "pos")
        if self.stops is not None:
            missed = missed.join(self.stops, HOST, "left").filter(before_stop(F.col(STOP), F.col("pos"), inclusive=True)).drop(STOP)
        return missed

    def listed(self, outcome: str) -> DataFrame:
        """The found rows and a row per miss, which has ``outcome`` and the facts of an empty job."""
        missed = job_facts(self.misses().withColumn("settings", F.lit(None).cast(SETTINGS)))
        missed = missed.withColumns({"scanned": F.lit(True), "matched": F.lit(False), "outcome": F.lit(outcome)})
        return self.found.unionByName(missed, allowMissingColumns=True)


def start(jobs: DataFrame, ids: DataFrame, hosts: Sequence[str], outcome: Column) -> Lookup:
    """A lookup of ``ids`` (``job_id``, ``pos``, each id once) in the workspaces ``hosts``; found jobs have ``outcome``."""
    return Lookup(look_up(jobs, ids, hosts, outcome), ids, list(dict.fromkeys(hosts)))
