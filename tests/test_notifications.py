import pytest
from pyspark.sql import functions as F

import expected as ex
from conftest import block, fleet, job, random_jobs
from jobfleet.functions import notifications as n
from jobfleet.schemas import DEFAULT_EVENTS, EVENT_FIELDS

def current():
    return F.col("settings.webhook_notifications")


def lists(value):
    """Lists of ids per event; absent events are left out."""
    if value is None:
        return None
    return {e: [w.id for w in value[e]] for e in EVENT_FIELDS if value[e] is not None}


@pytest.fixture(scope="module")
def rows():
    return random_jobs(7, 400)


@pytest.mark.parametrize("webhook_id", ["x", "new", ""])
@pytest.mark.parametrize("events", [DEFAULT_EVENTS, EVENT_FIELDS, ("on_start",), ()])
def test_attach_lists(spark, rows, webhook_id, events):
    frame = fleet(spark, rows).select(
        "job_id",
        n.attached_to_all(current(), webhook_id, events).alias("attached"),
        n.with_webhook(current(), webhook_id, events).alias("new"),
    )
    found = {r.job_id: r for r in frame.collect()}
    for row in rows:
        before = ex.fact(row)
        got = found[before.job_id]
        assert got.attached == ex.attached(before, webhook_id, events)
        if not got.attached:
            assert lists(got.new) == ex.lists_with(before, webhook_id, events)


@pytest.mark.parametrize("webhook_id", ["x", "absent", "", None])
@pytest.mark.parametrize("as_column", [False, True])
def test_detach_lists(spark, rows, webhook_id, as_column):
    wanted = F.lit(webhook_id).cast("string") if as_column else webhook_id
    after = n.without_webhook(current(), wanted)
    frame = fleet(spark, rows).select("job_id", current().alias("old"), after.alias("new")).select(
        "job_id",
        "new",
        n.removed_count(F.col("old"), F.col("new")).alias("count"),
        n.ids_removed(F.col("old"), F.col("new"), wanted).alias("ids"),
        n.events_affected(F.col("old"), F.col("new")).alias("events"),
    )
    found = {r.job_id: r for r in frame.collect()}
    for row in rows:
        gone = ex.removal(ex.fact(row), webhook_id)
        got = found[row[2]]
        assert (lists(got.new), got["count"], got.ids, got.events) == (gone.lists, gone.count, gone.ids, gone.events)


def test_attached_to_any(spark, rows):
    frame = fleet(spark, rows).select("job_id", n.attached_to_any(current(), "y").alias("attached"))
    found = {r.job_id: r.attached for r in frame.collect()}
    for row in rows:
        assert found[row[2]] == any("y" in ids for ids in (ex.fact(row).lists or {}).values())


def test_no_target_events_count_as_attached_only_with_a_block(spark):
    frame = fleet(spark, [job(1, hooks=block()), job(2)])
    found = frame.orderBy("job_id").select(n.attached_to_all(current(), "x", [])).collect()
    assert [r[0] for r in found] == [True, False]


def test_flat_ids_tells_null_from_empty(spark):
    frame = fleet(spark, [job(1, hooks=block(on_start=[], on_failure=["a", "b"]))])
    row = frame.select(*[n.flat_ids(current()[e]).alias(e) for e in EVENT_FIELDS]).first()
    assert (row.on_start, row.on_success, row.on_failure) == ("", "<null>", "a,b")
