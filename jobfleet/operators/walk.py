"""The walk over a workspace listing, as flags on the job rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobfleet.functions.filters import (
    display_name,
    is_bundle,
    name_contains,
    owner_in,
    tag_matches,
)
from jobfleet.operators.caps import STOP, before_stop, stop_ordinals
from jobfleet.schemas import HOST, ORDINAL


def job_facts(jobs: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """Add the parts of ``settings`` that planners and reports use as columns, but for those ``known`` already.

    Later steps name these columns instead of ``settings``. The scan then reads
    only the nested fields a query needs, also where projections pile up.
    """
    facts = {
        "is_bundle": is_bundle(),
        "job_name": display_name(),
        "metadata_path": F.col("settings.deployment.metadata_file_path"),
        "notifications": F.col("settings.webhook_notifications"),
    }
    return jobs.withColumns({name: fact for name, fact in facts.items() if name not in known})


def walk(
    jobs: DataFrame,
    *,
    tag: str | None = None,
    owners: Sequence[str] | None = None,
    name_filter: str | None = None,
    scan_limit: int | None = None,
    keep_all: bool = False,
) -> DataFrame:
    """Add ``scanned``, ``matched`` and the job facts to each job.

    Order of effect: the name filter decides what is listed, the scan cap how
    far the listing is read (the row that reaches it counts as scanned but is
    not processed), owner and tag what matches. Jobs the name filter leaves
    out are dropped at the scan unless ``keep_all`` is set.
    """
    listed = name_contains(name_filter)
    if not keep_all:
        jobs = jobs.filter(listed)
        listed = F.lit(True)
    wanted = listed & owner_in(owners) & tag_matches(tag)
    if scan_limit is None:
        return job_facts(jobs.withColumns({"scanned": listed, "matched": wanted}))
    stops = stop_ordinals(jobs.filter(listed), max(scan_limit, 1))
    stop, ordinal = F.col(STOP), F.col(ORDINAL)
    flagged = jobs.join(stops, HOST, "left").withColumns(
        {
            "scanned": listed & before_stop(stop, ordinal, inclusive=True),
            "matched": wanted & before_stop(stop, ordinal, inclusive=False),
        }
    )
    return job_facts(flagged.drop(STOP))


def matched_jobs(jobs: DataFrame, **scope) -> DataFrame:
    return walk(jobs, **scope).filter("matched").drop("scanned", "matched")
