import json

import pytest
from pyspark.sql import functions as F

from jobfleet import runs
from jobfleet.operators import bundles as ops
from jobfleet.schemas import EVENT_FIELDS
from jobfleet.sources import bundles as b
from test_notifications import lists


def nodes(spark, *texts, **named):
    rows = [("one", f"f{i}.yml", text) for i, text in enumerate(texts)]
    rows += [("one", name, text) for name, text in named.items()]
    return b.job_nodes(b.parse_documents(spark.createDataFrame(rows, "bundle string, path string, content string")))


def plan(spark, *texts, webhook_id="WID", **scope):
    return ops.bundle_patch_plan(nodes(spark, *texts), webhook_id, **scope)


def stats(frame):
    return ops.bundle_patch_stats(frame).first().asDict()


VARIABLES = """
resources:
  jobs:
    nightly_load:
      name: Nightly load
      webhook_notifications:
        on_failure: [{ id: "${var.pager}" }]
        on_duration_warning_threshold_exceeded: [{ id: "${var.pager}" }]
"""

BASE = """
resources:
  jobs:
    stock_sync:
      name: Stock sync
      tags: { area: retail }
"""

OVERRIDE = """
targets:
  live:
    resources:
      jobs:
        stock_sync:
          max_concurrent_runs: 3
          webhook_notifications:
            on_failure: [{ id: live-pager }]
"""

ANCHORS = """
x-common: &common
  tags: { area: retail }
  max_concurrent_runs: 1
resources:
  jobs:
    orders: { <<: *common, name: Orders }
    returns: { <<: *common, name: Returns }
    refunds: { <<: *common, name: Refunds }
"""


def test_variable_references_are_skipped(spark):
    frame = plan(spark, VARIABLES)
    assert stats(frame) == {
        "bundle": "one", "files_changed": 0, "jobs_seen": 1, "jobs_matched": 1, "jobs_patched": 0,
        "overrides_skipped": 0, "var_skipped_events": 2,
    }
    assert frame.first().var_skipped == ["on_failure", "on_duration_warning_threshold_exceeded"]


def test_base_is_patched_and_reaches_the_target(spark):
    frame = plan(spark, BASE, OVERRIDE)
    rows = {x.label: x for x in frame.collect()}
    base = rows["resources.jobs.stock_sync"]
    override = rows["targets.live.resources.jobs.stock_sync"]
    patched = {"on_failure": ["WID"], "on_duration_warning_threshold_exceeded": ["WID"]}
    assert base.changed and lists(base.new_notifications) == patched
    assert not override.changed and override.dup_events == [] and not override.matched
    assert stats(frame) == {
        "bundle": "one", "files_changed": 1, "jobs_seen": 2, "jobs_matched": 1, "jobs_patched": 1,
        "overrides_skipped": 1, "var_skipped_events": 0,
    }
    deployed = ops.effective_notifications(ops.patched_bundle_jobs(frame), ops.override_nodes(frame)).first()
    assert deployed.target == "live"
    assert lists(deployed.notifications) == {
        "on_start": [], "on_success": [],
        "on_failure": ["WID", "live-pager"], "on_duration_warning_threshold_exceeded": ["WID"],
    }
    assert all(deployed.duplicate_ids[e] == [] for e in EVENT_FIELDS)


def test_override_with_the_same_id_is_warned_about_whatever_the_filters(spark):
    text = OVERRIDE.replace("[{ id: live-pager }]", "[{ id: WID }, { id: live-pager }]")
    frame = plan(spark, BASE, text, names=["no such job"])
    override = frame.filter("target IS NOT NULL").first()
    assert override.dup_events == ["on_failure"]
    assert stats(frame)["jobs_seen"] == 2 and stats(frame)["jobs_matched"] == 0
    full = plan(spark, BASE, text)
    deployed = ops.effective_notifications(ops.patched_bundle_jobs(full), ops.override_nodes(full)).first()
    assert deployed.duplicate_ids.on_failure == ["WID"]


def test_every_consumer_of_an_anchor_is_patched(spark):
    frame = plan(spark, ANCHORS, tag="area=retail")
    assert stats(frame)["jobs_patched"] == 3
    assert {x.job_key for x in frame.filter("changed").collect()} == {"orders", "returns", "refunds"}


def test_patching_twice_changes_nothing(spark):
    doc = {"resources": {"jobs": {"j": {"webhook_notifications": {
        "on_failure": [{"id": "a"}, {"id": "WID"}], "on_duration_warning_threshold_exceeded": [{"id": "WID"}]}}}}}
    row = plan(spark, json.dumps(doc)).first()
    assert row.matched and not row.changed
    assert lists(row.new_notifications)["on_failure"] == ["a", "WID"]


def test_partial_patch_keeps_other_events(spark):
    doc = {"resources": {"jobs": {"j": {"webhook_notifications": {
        "on_start": [{"id": "s"}], "on_failure": [{"id": "${var.x}"}], "on_duration_warning_threshold_exceeded": None}}}}}
    row = plan(spark, json.dumps(doc)).first()
    assert row.changed and row.var_skipped == ["on_failure"]
    assert lists(row.new_notifications) == {
        "on_start": ["s"], "on_failure": ["${var.x}"], "on_duration_warning_threshold_exceeded": ["WID"],
    }


ODD = [
    "", "# only a comment\n", "null", "[1, 2]", "text", "resources: [a]\n", "resources:\n  jobs: [a]\n",
    "resources:\n  jobs:\n    a: null\n    b: [1]\n    c: text\n    d: {}\n",
    "targets: 5\n", "targets:\n  dev: null\n  prod:\n    resources:\n      jobs: text\n",
]


def test_only_mappings_are_nodes(spark):
    assert [x.label for x in nodes(spark, *ODD).collect()] == ["resources.jobs.d"]


def test_malformed_yaml_fails_its_own_bundle_only(spark):
    rows = [("a", "root.yml", "include: ['*.yml']"), ("a", "x.yml", "k: [1,\n"), ("a", "y.yml", BASE)]
    rows += [("b", "root.yml", "include: ['*.yml']"), ("b", "y.yml", BASE), ("c", "root.yml", "")]
    run = runs.patch(spark.createDataFrame(rows, "bundle string, path string, content string"), "WID", root_file="root.yml")
    assert [(x.bundle, x.path) for x in run.errors.collect()] == [("a", "x.yml")] and run.failed
    assert {x.bundle for x in run.plan.collect()} == {"b"}
    assert {(x.bundle, x.jobs_seen, x.jobs_patched) for x in run.stats.collect()} == {("b", 1, 1), ("c", 0, 0)}


def test_all_bundles_without_a_root_are_listed(spark):
    files = spark.createDataFrame([(f"b{i:02}", "x.yml", "") for i in range(30)], "bundle string, path string, content string")
    assert b.missing_roots(files, "root.yml").count() == 30
    with pytest.raises(b.MissingRoots, match="30 bundle"):
        b.require_roots(files, "root.yml")


def test_every_target_deploys_base_jobs_and_its_own(spark):
    only = "targets:\n  test: {resources: {jobs: {extra: {webhook_notifications: {on_start: [{id: s}]}}}}}\n"
    frame = plan(spark, BASE, OVERRIDE, only)
    targets = spark.createDataFrame([("one", "live"), ("one", "test")], "bundle string, target string")
    rows = ops.effective_notifications(ops.patched_bundle_jobs(frame), ops.override_nodes(frame), targets).collect()
    found = {(x.target, x.job_key): lists(x.notifications)["on_failure"] for x in rows}
    assert found == {("live", "stock_sync"): ["WID", "live-pager"], ("test", "stock_sync"): ["WID"], ("test", "extra"): []}
    none = ops.effective_notifications(ops.patched_bundle_jobs(frame), ops.override_nodes(frame).limit(0), targets.limit(0))
    assert [(x.target, x.job_key) for x in none.collect()] == [(None, "stock_sync")]


SCALARS = """
resources:
  jobs:
    number: {tags: {k: 1}}
    quoted: {tags: {k: '1'}}
    flag: {tags: {k: true}}
    word: {tags: {k: yes}}
    day: {tags: {k: 2024-01-01}}
    nothing: {tags: {k: null}}
    listed: {tags: [k]}
    absent: {}
"""


def test_tags_are_compared_without_conversion(spark):
    frame = nodes(spark, SCALARS)

    def matching(tag):
        return sorted(x.job_key for x in frame.filter(ops.node_tagged(tag)).collect())

    assert matching("k=1") == ["quoted"]
    assert matching("k=true") == []
    assert matching("k=yes") == ["word"]
    assert matching("k=2024-01-01") == []
    assert matching("k") == ["day", "flag", "nothing", "number", "quoted", "word"]
    assert matching("=1") == []  # an empty key is a real key here
    assert len(matching(None)) == 8


PERMISSIONS = {
    "owner": [{"level": "IS_OWNER", "user_name": "ann"}],
    "manager": [{"level": "CAN_VIEW", "user_name": "ann"}, {"level": "CAN_MANAGE", "group_name": "team"}],
    "service": [{"level": "CAN_MANAGE", "service_principal_name": "sp"}],
    "viewer": [{"level": "CAN_VIEW", "user_name": "ann"}],
    "runner": [{"level": "CAN_MANAGE_RUN", "user_name": "ann"}],
    "odd": ["text", None, {"level": "IS_OWNER", "user_name": 5}, {"user_name": "ann"}],
    "mapping": {"level": "IS_OWNER", "user_name": "ann"},
}


def test_permission_owners(spark):
    doc = {"resources": {"jobs": {k: {"permissions": v} for k, v in PERMISSIONS.items()} | {"none": {}}}}
    frame = nodes(spark, json.dumps(doc))

    def owned(*owners):
        return sorted(x.job_key for x in frame.filter(ops.node_owned_by(owners)).collect())

    assert owned("ann") == ["owner"]
    assert owned("team", "sp") == ["manager", "service"]
    assert owned("5") == []
    assert len(owned()) == 8


def test_names_match_text_only(spark):
    doc = {"resources": {"jobs": {"a": {"name": "x"}, "b": {"name": 1}, "c": {}}}}
    frame = nodes(spark, json.dumps(doc))
    assert [x.job_key for x in frame.filter(ops.node_named(["x", "1"])).collect()] == ["a"]


def test_yaml_and_json_of_one_document_agree(spark):
    as_json = json.dumps({"resources": {"jobs": {"j": {
        "name": "n", "tags": {"a": 14, "b": 12, "c": 1.5, "d": None, "e": "on"},
        "webhook_notifications": {"on_start": [{"id": "x"}, {"id": 7}, "bare"]}}}}})
    as_yaml = """
resources:
  jobs:
    j:
      name: n
      tags: {a: 014, b: 0o14, c: 1.5, d: ~, e: on}
      webhook_notifications:
        on_start:
          - id: x
          - id: 7
          - bare
"""
    found = nodes(spark, as_json, as_yaml).select("path", "notifications", F.to_json("node").alias("node")).collect()
    one, two = found
    assert json.loads(one.node) == json.loads(two.node)
    assert one.notifications == two.notifications
    assert [w.id for w in one.notifications.on_start] == ["x", None, None]
