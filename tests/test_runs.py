import pytest
from pyspark.sql import functions as F

from conftest import block, fleet, job
from jobfleet import runs
from jobfleet.operators.destinations import MissingDestinations
from jobfleet.sources.bundles import MissingRoots
from jobfleet.schemas import DESTINATIONS, METADATA, UPDATE_RESULTS
from jobfleet.sources.snapshots import read_inventory, read_removal_log


@pytest.fixture(scope="module")
def jobs(spark):
    on = block(on_failure=["x"])
    return fleet(
        spark,
        [
            job(1, "a", hooks=on, kind="BUNDLE", path="/b"), job(2, "a", hooks=on), job(3, "a", creator="bob"),
            job(4, "b", hooks=on), job(5, "b", kind="BUNDLE", path="/b"),
        ],
    )


@pytest.fixture(scope="module")
def metadata(spark):
    return spark.createDataFrame([("/b", "one", "prod", "g", "m", "c", "r", "f")], METADATA)


@pytest.fixture(scope="module")
def destinations(spark):
    return spark.createDataFrame([("a", 1, "ida", "hook", "W"), ("b", 1, "idb", "hook", "W")], DESTINATIONS)


def test_inventory_run(spark, tmp_path, jobs, metadata):
    table = str(tmp_path / "inventory")
    run = runs.inventory(jobs, metadata=metadata, table=table, output=str(tmp_path / "csv"), top_n=1)
    assert run.rows.count() == read_inventory(spark, table).count() == 5
    assert {(r.workspace_host, r.creator, r.jobs) for r in run.top_creators.collect()} == {("a", "ann", 2), ("b", "ann", 2)}
    assert {(r.workspace_host, r.bundle_name, r.jobs) for r in run.top_bundles.collect()} == {("a", "one", 1), ("b", "one", 1)}
    assert (tmp_path / "csv").exists()
    assert runs.inventory(jobs).top_bundles.count() == 0  # not enriched


def test_attach_run_by_name(spark, jobs, destinations):
    named, webhook_id = runs.resolve(jobs, destinations, "hook", runs.workspaces_of(jobs))
    run = runs.attach(named, webhook_id)
    ends = {r.job_id: r.new_notifications.on_failure[-1].id for r in run.plan.filter("outcome = 'would_update'").collect()}
    assert ends == {2: "ida", 3: "ida", 4: "idb"} and not run.failed
    with pytest.raises(MissingDestinations):
        runs.resolve(jobs, destinations.filter("workspace_host = 'a'"), "hook", runs.workspaces_of(jobs))


def test_runs_over_id_files(spark, tmp_path, jobs):
    path = tmp_path / "ids.csv"
    path.write_text("job_id,name\n2,x\n1,y\n")
    run = runs.attach(jobs, "new", job_id=[3, 2], job_ids_from=str(path), hosts=["a"])
    found = {r.job_id: (r.pos, r.outcome) for r in run.plan.collect()}
    assert {k: v[1] for k, v in found.items()} == {3: "would_update", 2: "would_update", 1: "bundle_skipped"}
    assert sorted(found, key=lambda k: found[k][0]) == [3, 2, 1]
    cleared = runs.detach(jobs, job_ids_from=str(path), hosts=["a", "b"])
    stats = {r.workspace_host: (r.would_update, r.errored) for r in cleared.stats.collect()}
    assert stats == {"a": (2, 0), "b": (0, 2)} and cleared.failed
    for bad in (
        lambda: runs.attach(jobs, "x", job_id=[1]),
        lambda: runs.detach(jobs, "x", job_id=[1], hosts=["a"], tag="k"),
        lambda: runs.detach(jobs),
    ):
        with pytest.raises(ValueError):
            bad()


def test_applied_detach_run(spark, tmp_path, jobs, metadata):
    log, report = str(tmp_path / "log"), str(tmp_path / "report")
    ok = spark.createDataFrame([("a", 2, True), ("b", 4, False)], UPDATE_RESULTS)
    run = runs.detach(jobs, "x", results=ok, metadata=metadata, removal_log=log, bundle_report=report)
    assert run.failed and (tmp_path / "report").exists()
    assert [r.job_id for r in read_removal_log(spark, log).collect()] == [2]
    assert sorted(r.job_id for r in run.bundle_report.collect()) == [1, 5]
    dry = runs.detach(jobs, "x", removal_log=str(tmp_path / "none"))
    assert dry.removals is None and not (tmp_path / "none").exists()


def test_create_destination_run(spark, destinations):
    hosts = spark.createDataFrame([("a",), ("c",)], "workspace_host string")
    plan = runs.create_destination(hosts, destinations, name="hook", url="http://h/x")
    assert {(r.workspace_host, r.action, r.unencrypted) for r in plan.collect()} == {
        ("a", "exists", True), ("c", "would_create", True),
    }
    with pytest.raises(ValueError, match="web address"):
        runs.create_destination(hosts, destinations, name="hook", url="ftp://h")


def test_patch_run_over_files(spark):
    rows = [
        ("one", "root.yml", "include: [jobs/*.yml]\ntargets:\n  prod:\n    resources:\n      jobs:\n        j: {}\n"),
        ("one", "jobs/a.yml", "resources:\n  jobs:\n    j: {name: n}\n"),
        ("one", "other/b.yml", "resources:\n  jobs:\n    k: {name: n}\n"),
        ("two", "root.yml", "resources:\n  jobs:\n    j:\n      name: n\n"),
    ]
    files = spark.createDataFrame(rows, "bundle string, path string, content string")
    with pytest.raises(MissingRoots, match="two"):
        runs.patch(files.filter("bundle = 'one' OR path <> 'root.yml'").unionByName(
            files.filter("path LIKE '%a.yml'").withColumn("bundle", F.lit("two"))), "WID", root_file="root.yml")
    run = runs.patch(files, "WID", root_file="root.yml")
    stats = {r.bundle: r.asDict() for r in run.stats.collect()}
    assert (stats["one"]["jobs_seen"], stats["one"]["jobs_patched"], stats["one"]["overrides_skipped"]) == (2, 1, 1)
    assert (stats["two"]["files_changed"], stats["two"]["jobs_seen"]) == (1, 1)


def test_a_run_has_one_time_and_counts_every_named_workspace(spark, tmp_path):
    jobs = fleet(spark, [job(1, hooks=block(on_failure=["x"]))])
    hosts = spark.createDataFrame([("h1",), ("h9",)], "workspace_host string")
    made = runs.inventory(jobs, table=str(tmp_path / "t"), workspaces=hosts, session_view=True)
    written = spark.read.parquet(str(tmp_path / "t")).first().scanned_at
    assert made.rows.first().scanned_at == written == spark.table("jobs_inventory_session").first().scanned_at
    assert {(x.workspace_host, x.total) for x in made.summary.collect()} == {("h1", 1), ("h9", 0)}
    run = runs.attach(jobs, "x", name_filter="none such", workspaces=hosts)
    assert {(x.workspace_host, x.scanned, x.errored) for x in run.stats.collect()} == {("h1", 0, 0), ("h9", 0, 0)}
