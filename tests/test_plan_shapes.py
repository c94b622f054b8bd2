"""Physical plans: what is read, what is shuffled, what runs in Python."""

from pathlib import Path
import re

import pytest

from jobfleet.operators import reports as r
from jobfleet.operators.enrich import enrich_bundles
from jobfleet.operators.walk import job_facts, matched_jobs
from jobfleet.plans.attach import attach_lookup, attach_walk
from jobfleet.plans.detach import detach_walk
from jobfleet.plans.updates import next_snapshot
from jobfleet.queries import registry, tables
from jobfleet.sources import bundles

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="benchmark tables not present")


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def jobs(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return tables.jobs(spark, SF_DIR)


def read_schema(plan):
    return re.findall(r"ReadSchema: (\S.*?)(?:\n|$)", plan)


def test_summary_reads_one_nested_field_and_shuffles_counts_only(jobs):
    plan = physical(r.inventory_summary(matched_jobs(jobs)))
    assert read_schema(plan) == ["struct<settings:struct<deployment:struct<kind:string>>>"]
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_name_and_owner_filters_reach_the_scan(jobs):
    plan = physical(matched_jobs(jobs, name_filter="etl", owners=["ann"]).select("job_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "StringContains(settings.name,etl)" in pushed
    assert "EqualTo(creator_user_name,ann)" in pushed or "In(creator_user_name" in pushed


def test_workspace_filter_prunes_partitions(jobs):
    plan = physical(r.jobs_per_workspace(jobs.filter("workspace_host = 'ws-1'")))
    assert re.search(r"PartitionFilters: \[[^\]]*workspace_host", plan)


@pytest.mark.parametrize("planner", [attach_walk, detach_walk])
def test_planning_and_the_next_snapshot_need_no_shuffle(jobs, planner):
    plan = physical(next_snapshot(planner(jobs, "wh-3", keep_all=True)))
    assert "Exchange" not in plan and "Join" not in plan


def test_plans_read_only_the_nested_fields_they_use(jobs):
    for frame in (
        registry.flat_plan(attach_walk(jobs, "wh-3")),
        r.attach_run_stats(attach_walk(jobs, "wh-3", limit=20)),
        registry.flat_detach(detach_walk(jobs, "wh-3", scan_limit=200)),
    ):
        (schema,) = [s for s in read_schema(physical(frame)) if "settings" in s]
        assert "tags" not in schema and "settings:struct<name" not in schema


def test_capped_plans_filter_by_a_broadcast_stop(jobs):
    plan = physical(attach_walk(jobs, "wh-3", scan_limit=200, limit=20))
    assert plan.count("BroadcastHashJoin") == 2
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_applied_and_capped_runs_scan_the_fleet_once(spark, jobs):
    results = tables.update_results(spark, SF_DIR)
    fleet_schema = re.compile(r"ReadSchema: struct<[^\n]*settings")
    for planner in (attach_walk, detach_walk):
        for limit in (None, 20):
            plan = physical(planner(jobs, "wh-3", results=results, limit=limit))
            assert len(fleet_schema.findall(plan)) == 1 and "Union" not in plan
            assert "Exchange hashpartitioning" not in plan  # few verdicts are broadcast


def test_rows_that_were_not_sent_do_not_meet_in_one_task(spark, jobs):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = attach_walk(jobs, "wh-3", results=tables.update_results(spark, SF_DIR))
        text = physical(plan)
        assert text.count("SortMergeJoin") == 1 and "hashpartitioning(sent_host" in text
        keys = plan.filter("outcome not in ('updated', 'errored')").count()
        assert keys > 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lookups_join_the_fleet_once_and_have_no_row_per_miss(spark, jobs):
    ids = spark.range(5000).selectExpr("id as job_id", "id as pos")
    run = attach_lookup(jobs, ids, ["ws-0", "ws-1", "ws-2"], "wh-3", limit=50)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (run.found, r.with_misses(r.attach_run_stats(run.found), run.miss_counts())):
            plan = physical(frame)
            assert "Generate" not in plan and "explode" not in plan
            scans = re.findall(r"ReadSchema: struct<[^\n]*job_id[^\n]*settings", plan)
            assert len(scans) <= 2  # the plan's rows, and again to count what was found
        assert physical(attach_lookup(jobs, ids, ["ws-0"], "wh-3").found).count("hashpartitioning(job_id") == 2  # jobs and ids
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_metadata_join_broadcasts_by_size_and_is_left_out_unless_asked(spark, jobs):
    assert "Join" not in physical(enrich_bundles(job_facts(jobs), None))
    metadata = tables.metadata(spark, SF_DIR)
    assert "BroadcastHashJoin" in physical(enrich_bundles(job_facts(jobs), metadata))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "SortMergeJoin" in physical(enrich_bundles(job_facts(jobs), metadata))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_top_k_prunes_before_the_shuffle(jobs):
    assert physical(r.top_creators(matched_jobs(jobs), 10)).count("WindowGroupLimit") == 2


def test_python_runs_only_to_read_yaml(spark):
    for name in ("attach_plan", "detach_one", "removal_log", "bundle_patch_plan", "bundle_metadata"):
        assert "Python" not in physical(registry.queries()[name](spark, SF_DIR)), name
    docs = bundles.parse_documents(tables.bundle_files(spark, SF_DIR))
    assert physical(bundles.job_nodes(docs)).count("ArrowEvalPython") == 1
