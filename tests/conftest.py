from pathlib import Path
import random
import sys

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from jobfleet.schemas import EVENT_FIELDS, JOBS
from jobfleet.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, partitions=2)


def block(**events):
    """A notifications block from lists of ids; events left out are null."""
    return tuple(
        None if events.get(e) is None else [(i,) for i in events[e]] for e in EVENT_FIELDS
    )


def job(job_id, host="h1", ordinal=None, creator="ann", name="job", tags=None, kind=None, path=None,
        hooks=None, settings=True):
    deployment = None if kind is None and path is None else (kind, path)
    return (
        host,
        job_id if ordinal is None else ordinal,
        job_id,
        creator,
        (name, tags, deployment, hooks) if settings else None,
    )


def fleet(spark, rows):
    return spark.createDataFrame(rows, JOBS)


def random_jobs(seed, count, hosts=("h1", "h2", "h3")):
    """Jobs with every oddity: null settings, blocks, lists and ids, repeats, gaps in the listing.

    About a third of the jobs sit on the first host.
    """
    rng = random.Random(seed)
    ids = ["x", "y", "z", "", None]

    def hooks():
        if rng.random() < 0.15:
            return None
        return tuple(
            None if rng.random() < 0.3 else [(rng.choice(ids),) for _ in range(rng.randrange(4))]
            for _ in EVENT_FIELDS
        )

    rows, ordinal = [], 0
    for job_id in range(count):
        ordinal += rng.randrange(1, 4)
        rows.append(
            job(
                job_id,
                host=hosts[0] if rng.random() < 0.34 else rng.choice(hosts),
                ordinal=ordinal,
                creator=rng.choice(["ann", "bob", "", None]),
                name=rng.choice(["etl-1", "etl-2", "report", "", None]),
                tags=rng.choice([None, {}, {"team": "a"}, {"team": "b", "tier": ""}]),
                kind=rng.choice([None, "BUNDLE", "bundle", "my_bundle_kind", "MANUAL"]),
                path=rng.choice([None, "/b/1", "/b/2"]),
                hooks=hooks(),
                settings=rng.random() > 0.05,
            )
        )
    return rows
