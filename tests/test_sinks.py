from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import block, fleet, job
from jobfleet import staging
from jobfleet import sinks
from jobfleet.operators.walk import matched_jobs
from jobfleet.plans.detach import detach_walk, removal_records
from jobfleet.plans.inventory import inventory_rows
from jobfleet.schemas import INVENTORY, REMOVAL_LOG, SESSION_VIEW, UPDATE_RESULTS
from jobfleet.sources import snapshots
from jobfleet.sources.snapshots import read_inventory, read_removal_log
from jobfleet.staging import staging_root


def inventory(spark, rows, when="2024-01-01 00:00:00"):
    return inventory_rows(matched_jobs(fleet(spark, rows)), F.lit(when))


def stored(spark, path):
    return sorted((r.workspace_host, r.job_id, r.name) for r in read_inventory(spark, path).collect())


def test_overwrite_replaces_only_scanned_workspaces(spark, tmp_path):
    path = str(tmp_path / "inv")
    sinks.overwrite_inventory(inventory(spark, [job(1, "a"), job(2, "a"), job(3, "b")]), path)
    sinks.overwrite_inventory(inventory(spark, [job(2, "a", name="new"), job(4, "c")]), path)
    assert stored(spark, path) == [("a", 2, "new"), ("b", 3, "job"), ("c", 4, "job")]
    # No rows: nothing is written, stale partitions stay.
    sinks.overwrite_inventory(inventory(spark, []), path)
    assert len(stored(spark, path)) == 3


def test_csv_has_fixed_columns_and_nothing_between_commas(spark, tmp_path):
    path = str(tmp_path / "csv")
    assert sinks.write_inventory_csv(inventory(spark, [job(1, creator=None, name=' a,"b"')]), path)
    texts = [p.read_text().splitlines() for p in Path(path).glob("*.csv")]
    assert max(texts, key=len) == [
        "job_id,name,creator,deployment_kind,bundle_name,target,git_origin,git_branch,git_commit,"
        "workspace_root,workspace_file_path,metadata_file_path",
        '1," a,""b""",,DIRECT,,,,,,,,',
    ]


@pytest.mark.parametrize("path, rows", [("", [job(1)]), ("x", [])])
def test_no_csv_without_path_or_rows(spark, tmp_path, path, rows):
    target = str(tmp_path / path) if path else ""
    assert not sinks.write_inventory_csv(inventory(spark, rows), target)
    assert not (tmp_path / "x").exists()


def test_removal_log_only_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    hooks = block(on_start=["x"])
    jobs = fleet(spark, [job(1, "a", hooks=hooks), job(2, "b", hooks=hooks)])
    ok = spark.createDataFrame([("a", 1, True), ("b", 2, True)], UPDATE_RESULTS)

    def record(when, results):
        plan = detach_walk(jobs, "x", results=results)
        sinks.append_removal_log(removal_records(plan, None, F.lit(when)), path)

    record("2024-01-01", ok)
    record("2024-01-02", ok.filter("job_id = 1"))
    record("2024-01-03", None)  # a dry run leaves no trace
    log = read_removal_log(spark, path)
    assert sorted((r.job_id, r.deleted_at.day) for r in log.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_session_view_needs_rows_and_no_failures(spark):
    spark.catalog.dropTempView(SESSION_VIEW)
    assert not sinks.create_session_view(inventory(spark, []))
    failed = spark.createDataFrame([("a", 1)], "workspace_host string, errored long")
    assert not sinks.create_session_view(inventory(spark, [job(1)]), failed)
    assert SESSION_VIEW not in [t.name for t in spark.catalog.listTables()]
    assert sinks.create_session_view(inventory(spark, [job(1)]), failed.limit(0))
    assert spark.table(SESSION_VIEW).count() == 1


def test_staging_uses_the_session_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    root = staging_root(spark)
    assert root == staging_root(spark)
    assert root.endswith("/jobfleet-" + spark.sparkContext.applicationId)
    assert configured is None or root.startswith(configured.rstrip("/"))


def test_staged_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "staging_root", lambda spark: str(tmp_path / "own"))
    (tmp_path / "other").mkdir()
    assert staging.stage(spark.range(3), "three").count() == 3
    staging.clear_staged(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


# Parts of different ages ---------------------------------------------------


def log_row(host, job_id, **more):
    row = {f.name: "" for f in REMOVAL_LOG.fields} | {"workspace_host": host, "job_id": job_id, "is_bundle": False}
    return row | {"deleted_at": datetime(2024, 1, 1), "webhook_ids_removed": ["x"], "events_affected": []} | more


def log_rows(spark, *rows):
    return spark.createDataFrame([tuple(r[f.name] for f in REMOVAL_LOG.fields) for r in rows], REMOVAL_LOG)


def test_parts_of_a_log_may_lack_columns_and_have_more(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_removal_log(log_rows(spark, log_row("01", 1)).drop("git_commit", "events_affected"), path)
    sinks.append_removal_log(log_rows(spark, log_row("01", 2)), path)
    sinks.append_removal_log(log_rows(spark, log_row("b", 3)).withColumn("ticket", F.lit(7)), path)
    log = snapshots.read_removal_log(spark, path)
    assert log.columns == [*(f.name for f in REMOVAL_LOG.fields), "ticket"]
    found = {r.job_id: (r.workspace_host, r.git_commit, r.events_affected, r.ticket) for r in log.collect()}
    assert found == {1: ("01", None, None, None), 2: ("01", "", [], None), 3: ("b", "", [], 7)}


def test_columns_keep_their_types(spark, tmp_path):
    path, rows = str(tmp_path / "log"), log_rows(spark, log_row("a", 1))
    bad = [rows.withColumn("job_id", F.col("job_id").cast("string")), rows.withColumnRenamed("name", "NAME"), rows.drop("workspace_host")]
    for frame in bad:  # an empty table knows its own columns
        with pytest.raises(sinks.SchemaConflict):
            sinks.append_removal_log(frame, path)
    sinks.append_removal_log(rows.withColumn("ticket", F.lit(7)), path)
    for frame in [*bad, rows.withColumn("ticket", F.lit("7"))]:
        with pytest.raises(sinks.SchemaConflict):
            sinks.append_removal_log(frame, path)
    assert snapshots.read_removal_log(spark, path).count() == 1


def test_a_wider_inventory_keeps_older_partitions(spark, tmp_path):
    path = str(tmp_path / "inventory")
    rows = spark.createDataFrame(
        [("a", datetime(2024, 1, 1), 1, *[""] * 11), ("b", datetime(2024, 1, 1), 2, *[""] * 11)], INVENTORY
    )
    sinks.overwrite_inventory(rows, path)
    sinks.overwrite_inventory(rows.filter("workspace_host = 'b'").withColumn("region", F.lit("eu")), path)
    found = {r.workspace_host: r.region for r in snapshots.read_inventory(spark, path).collect()}
    assert found == {"a": None, "b": "eu"}
